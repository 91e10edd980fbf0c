"""corpusmill: Spark-native curation and evaluation of training data for code and text models."""

__version__ = "0.1.0"
