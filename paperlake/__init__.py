"""Paperlake: build and query a knowledge base over a document corpus with Spark DataFrames."""

__version__ = "0.1.0"
