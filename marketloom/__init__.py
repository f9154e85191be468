"""Spark-native analytics for promotional retail offers."""
