"""Document analytics on Spark: documents, pages, lines and words as DataFrames."""

__version__ = "0.1.0"
