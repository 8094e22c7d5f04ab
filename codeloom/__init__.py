"""Batch code-translation dataflows as Spark DataFrames."""
