"""A Spark-native engine for long structured texts."""
