"""Spark-native analytics for image volumes, their metadata tables and text corpora."""

__version__ = "0.1.0"
