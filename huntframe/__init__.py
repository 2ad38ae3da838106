"""huntframe: a PySpark-native security-analytics engine."""

__version__ = "0.1.0"
