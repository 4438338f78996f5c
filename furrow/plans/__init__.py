"""Registered queries (Spark plans) and their SQL twins for the DuckDB oracle."""
