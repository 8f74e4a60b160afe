"""Links, star and simple schemas, semantic model, search, inspection, enrichment."""
