"""Spark-native hidden-content analytics over files and DataFrame columns."""
