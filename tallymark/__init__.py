"""Audit and comparison of numbered text collections, on Spark DataFrames."""
