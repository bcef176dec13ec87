"""Registered queries (Spark) and their DuckDB counterparts."""
