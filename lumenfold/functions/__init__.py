"""Scalar functions on photo columns."""
