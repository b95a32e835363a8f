"""Queries are over batch tables; there are no streaming operators. A catalog may still hold a streaming DataFrame, since
binding only builds a plan: filters, projections and watermarked groupings then run under Structured Streaming as Spark allows."""
