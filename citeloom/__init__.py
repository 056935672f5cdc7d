"""Cited-corpus analytics on Spark: every operator is a function from DataFrames to DataFrames."""

__version__ = "0.1.0"
