"""Sparse tensor algebra on Spark DataFrames."""
