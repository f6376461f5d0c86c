"""Spark-native hybrid retrieval, chunking, clustering and retrieval evaluation."""

__version__ = "0.1.0"
