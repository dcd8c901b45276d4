"""Customer-attrition analytics written for Spark DataFrames."""

__version__ = "0.1.0"
