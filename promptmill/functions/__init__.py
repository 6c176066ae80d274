"""Column expressions: text, vectors, hashes and fuzzy scores."""
