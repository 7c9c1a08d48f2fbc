"""Operators: DataFrames in, DataFrames out; every key includes the repo."""
