"""Column functions: canonical JSON, hashes and predicates."""
