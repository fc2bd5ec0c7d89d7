"""Spark-native analytics over event logs of distributed traces."""

__version__ = "0.1.0"
