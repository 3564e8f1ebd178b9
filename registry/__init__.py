"""Registered queries and their DuckDB counterparts, over the given tables."""
