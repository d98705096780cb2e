"""Spark-native audit of study records, and the data operators around it."""

__version__ = "0.1.0"
