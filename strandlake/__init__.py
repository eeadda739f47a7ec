"""Strandlake: Spark-native analytics over biological vectors, annotations and text corpora."""

__version__ = "0.1.0"
