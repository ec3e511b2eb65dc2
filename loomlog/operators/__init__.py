"""Operators: each takes DataFrames and returns a DataFrame; nothing runs until the caller acts."""
