"""functions of the pattern-search engine."""
