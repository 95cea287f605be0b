"""Operators that prepare text corpora. Nothing outside this subpackage imports it, except the query registry."""
