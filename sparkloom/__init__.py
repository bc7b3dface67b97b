"""Spark-native analytics over ordered, keyed tables."""
