"""Operators for training-data pipelines: deduplication, filters, packing, formatting."""
