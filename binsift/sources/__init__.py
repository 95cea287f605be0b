"""Scans and sinks: function records, ranked records, labels, reports, and the bridge views over the driver tables."""
