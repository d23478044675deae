"""Lodestar: search, extraction and analytics over text, key-value, JSON and tabular data on Spark DataFrames."""

__version__ = "0.1.0"
