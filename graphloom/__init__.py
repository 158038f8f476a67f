"""Analytics of code, its history and of text corpora on Spark."""

__version__ = "0.1.0"
