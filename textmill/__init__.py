"""A PySpark-native full-text search and document-analytics engine."""
