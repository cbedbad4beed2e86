"""Spark-native document segmentation, terminology and translation-QA engine."""

__version__ = "0.1.0"
