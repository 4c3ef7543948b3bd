"""Spark-native analytics over collected public notices."""
