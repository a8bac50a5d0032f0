"""Spark-native engine for claim data: sources, operators, plans and streaming."""

__version__ = "0.1.0"
