"""hushframe: a PySpark-native engine for finding, masking and restoring personal data in text."""

__version__ = "0.1.0"
