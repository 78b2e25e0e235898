"""Clusterings: each takes and returns DataFrames."""
