"""Spark-native analytics for large tables of short user comments."""

__version__ = "0.1.0"
