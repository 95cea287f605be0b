"""Relational, graph, scoring and state-machine operators over functions, operations, calls, rules and findings."""
