"""kinefold: analytics of moving-object recordings on Spark DataFrames."""

__version__ = "0.1.0"
