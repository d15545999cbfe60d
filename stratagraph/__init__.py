"""Graph analytics over source-like corpora as DataFrame and SQL plans."""
