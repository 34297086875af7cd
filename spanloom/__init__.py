"""Spark-native analytics for AI/ML observability data."""

__version__ = "0.1.0"
