"""Lossless approximate pattern matching over nucleotide collections, on Spark DataFrames."""
