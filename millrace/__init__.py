"""Spark-native learning and analytics over DataFrames."""

__version__ = "0.1.0"
