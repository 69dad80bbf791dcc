"""Set-at-a-time analysis of recorded coding sessions on Spark DataFrames."""

__version__ = "0.1.0"
