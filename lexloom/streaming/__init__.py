"""Spark-native streaming."""
