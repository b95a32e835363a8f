"""Checks that don't rest on Spark: DuckDB, structural properties, a row interpreter, agreement of dialects."""
