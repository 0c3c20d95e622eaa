"""Spark-native drift analytics for classifier confidence scores."""
