"""Structured Streaming ingest of function records."""
