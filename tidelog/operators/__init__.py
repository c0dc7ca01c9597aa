"""Functions from DataFrames to DataFrames over an operation log ``(seq, op, columns...)``."""
