"""Registered queries by topic; each pairs a Spark query with its DuckDB twin."""
