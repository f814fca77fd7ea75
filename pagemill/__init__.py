"""Web-page analytics on Spark: stored pages in, DataFrames out."""

__version__ = "0.1.0"
