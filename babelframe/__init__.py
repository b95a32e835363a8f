"""SQL in many dialects, answered by Spark."""
