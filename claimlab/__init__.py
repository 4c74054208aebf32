"""A Spark-native engine for validating time-series prediction claims."""
