"""Sparse matrices as ordinary Spark DataFrames, and the formats and kernels around them."""
