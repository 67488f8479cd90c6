"""streaming of the pattern-search engine."""
