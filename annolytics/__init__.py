"""annolytics: a PySpark-native analytics engine for text-annotation corpora."""

__version__ = "0.1.0"
