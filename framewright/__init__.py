"""Spark-native analytics for ordered feature streams."""
