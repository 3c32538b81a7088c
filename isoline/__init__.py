"""Spark-native geometry, sequence and review analytics."""
