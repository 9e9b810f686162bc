"""threadmill: a PySpark-native engine for conversation logs and text corpora."""

__version__ = "0.1.0"
