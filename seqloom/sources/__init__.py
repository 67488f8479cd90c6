"""sources of the pattern-search engine."""
