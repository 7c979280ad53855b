"""Scalar expressions: casts from text, and display formatting."""
