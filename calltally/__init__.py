"""Spark-native analytics over logs of AI model calls."""
