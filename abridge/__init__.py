"""Extractive multi-document summarisation as PySpark DataFrame plans."""

__version__ = "0.1.0"
