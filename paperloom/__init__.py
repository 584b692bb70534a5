"""Set-at-a-time search, ranking and evaluation of scholarly papers on Spark DataFrames."""

__version__ = "0.1.0"
