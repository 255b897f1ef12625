"""Scalar functions as Column builders; no Python runs per row."""
