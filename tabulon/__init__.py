"""Analytics pipelines as functions from DataFrames to DataFrames."""

__version__ = "0.1.0"
