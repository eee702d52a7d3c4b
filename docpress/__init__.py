"""Compressed documents on Spark: build them, store them, measure them."""

__version__ = "0.1.0"
