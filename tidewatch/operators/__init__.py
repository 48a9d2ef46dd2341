"""Operators: each takes DataFrames and returns a tidy DataFrame."""
