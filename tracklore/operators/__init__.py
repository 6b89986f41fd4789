"""Operators: DataFrames in, a DataFrame with a declared schema out."""
