"""Spark-native frame-sequence summarization and corpus preparation."""

__version__ = "0.1.0"
