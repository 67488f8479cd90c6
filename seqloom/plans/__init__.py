"""plans of the pattern-search engine."""
