"""Operators of a training-data pipeline: deduplication, filtering, counting, mixing, packing and search."""
