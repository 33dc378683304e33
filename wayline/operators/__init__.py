"""Operators on DataFrames: each takes and returns lazy plans."""
