"""Cairnlink: record linkage and data preparation as PySpark DataFrame programs."""

__version__ = "0.1.0"
