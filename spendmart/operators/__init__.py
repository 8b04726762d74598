"""Relational operators: every function maps DataFrames to DataFrames and is lazy."""
