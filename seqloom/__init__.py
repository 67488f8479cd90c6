"""Text-pattern analytics on PySpark: search, index views, alignment records."""
