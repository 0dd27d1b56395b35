"""Spark-native analytics over archives of agent sessions."""

__version__ = "0.1.0"
