"""A Spark-native engine for query-aware text compression."""
