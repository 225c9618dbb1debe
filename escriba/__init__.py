"""Spark-native evaluation and mining of text transcriptions."""

__version__ = "0.1.0"
