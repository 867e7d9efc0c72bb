"""Operators for large-scale training-data pipelines; self-contained, nothing outside imports it."""
