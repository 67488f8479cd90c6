"""operators of the pattern-search engine."""
