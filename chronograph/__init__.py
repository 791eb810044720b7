"""Spark-native analytics and representation learning on temporal graphs."""

__version__ = "0.1.0"
