"""Scalar functions: geometry, text, number formats."""
