"""Operators for training-data pipelines: scans, packing, deduplication, scoring."""
