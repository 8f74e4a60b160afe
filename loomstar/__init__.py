"""Session analytics on Spark: transcripts to a star schema, queries over it, and what surrounds them."""
