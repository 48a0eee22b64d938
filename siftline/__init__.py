"""Spark-native search and analysis of code, text and knowledge tables."""

__version__ = "0.1.0"
