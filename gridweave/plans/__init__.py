"""Iterative plans that run operators in rounds."""
