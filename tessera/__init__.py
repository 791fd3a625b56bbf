"""Spark-native analytics over document and evidence collections."""
