"""Predicates and the windows that they reach."""
