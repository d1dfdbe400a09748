"""Operators: each takes and returns DataFrames and neither prints nor collects rows."""
