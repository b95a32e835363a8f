"""Tables in: Parquet, literals, SQLite, JSON tables, a generator. Rows out."""
