"""siftline: auditing, scoring, selecting and analysing training data with Spark DataFrames."""

__version__ = "0.1.0"
