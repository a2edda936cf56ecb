"""cairn: a PySpark-native data-quality and training-data analytics engine."""

__version__ = "0.1.0"
