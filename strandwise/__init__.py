"""Strand-aware interval analytics on Spark DataFrames."""
