"""Spark-native acoustic event analytics."""
