"""Spark-native index and search analytics."""
