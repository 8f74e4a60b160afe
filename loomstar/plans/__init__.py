"""Transcripts made from the given tables, the catalogue of analytic queries, and their registry."""
