"""Operators for large-scale training-data preparation. Nothing else in viewloom imports this subpackage."""
