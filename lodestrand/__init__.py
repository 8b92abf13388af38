"""Lodestrand: evidence retrieval and corpus preparation expressed as PySpark plans."""

__version__ = "0.1.0"
