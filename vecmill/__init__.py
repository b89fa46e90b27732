"""A PySpark-native engine for multi-vector and late-interaction retrieval."""

__version__ = "0.1.0"
