"""Registered queries: a dict QUERIES of callables and a dict SQL of DuckDB statements in each module."""
