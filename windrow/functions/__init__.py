"""Scalar functions: intervals, types and points in time."""
