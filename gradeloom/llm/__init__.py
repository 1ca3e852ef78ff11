"""Operators of a training-data pipeline: deduplication, filtering, sharding and packing."""
