"""Wayline: trajectory analytics on Spark DataFrames."""
