"""Lodestone: data-mining and analytics operators over Spark DataFrames."""

__version__ = "0.1.0"
