"""Spark-native analytics over bibliographic evidence and manuscript text."""
