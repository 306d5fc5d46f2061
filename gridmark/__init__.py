"""gridmark: Spark-native preparation, scoring and comparison of machine-read tables."""
