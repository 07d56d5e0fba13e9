"""Operators: DataFrames and parameters in, a DataFrame out; no state, no collects."""
