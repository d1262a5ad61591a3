"""glyphline: a PySpark-native engine for exact text and byte analytics."""

__version__ = "0.1.0"
