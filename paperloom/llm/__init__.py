"""Operators for large-scale training-data pipelines. Nothing else in paperloom imports this subpackage."""
