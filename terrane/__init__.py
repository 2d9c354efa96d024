"""A Spark-native engine for typed single-table queries, geography and training-data work."""
