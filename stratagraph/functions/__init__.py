"""Column functions: full text, paths, JSON."""
