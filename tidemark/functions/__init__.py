"""Column functions: text, paths, predicates, hashing."""
