"""Relational operators of the store: each takes and returns DataFrames."""
