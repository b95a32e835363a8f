"""Scalar, aggregate and window functions by name."""
