"""grainmill: Spark-native curation and evaluation analytics for text and code training data."""

__version__ = "0.1.0"
