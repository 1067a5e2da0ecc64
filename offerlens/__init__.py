"""offerlens: a Spark-native engine for finding undervalued offers in product listings."""

__version__ = "0.1.0"
