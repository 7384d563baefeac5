"""Operators for training data: quality, deduplication, formatting, packing."""
