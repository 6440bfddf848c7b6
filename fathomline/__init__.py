"""Spark-native repository, evidence and text analytics."""
