"""Column functions: each takes and gives Spark columns."""
