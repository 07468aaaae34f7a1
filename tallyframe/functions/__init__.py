"""Column functions: codes, scores, similarity, sites, pages and nested JSON."""
