"""Operators for preparing language-model training data, each on Spark DataFrames."""
