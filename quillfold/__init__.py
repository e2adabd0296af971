"""Event-log analytics on Spark: fold, query, navigate, compare and follow records."""
