"""Spark-native analytics for structured-extraction studies."""
