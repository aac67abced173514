"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it may import the
library's general helpers.
"""
