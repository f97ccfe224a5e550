"""Equity screening on Spark DataFrames."""
