"""Spark-native analytics for line-level text recognition data."""
