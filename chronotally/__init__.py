"""Temporal statistics on Spark DataFrames."""
