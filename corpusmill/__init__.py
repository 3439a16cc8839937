"""Corpus building, batch retrieval, retrieval evaluation and request-log analytics on Spark."""

__version__ = "0.1.0"
