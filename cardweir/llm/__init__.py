"""Operators of a training-data pipeline: deduplication, mixing, packing, screening and search."""
