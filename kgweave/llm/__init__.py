"""Operators for preparing training data: search, deduplication, filters, counts, mixing, sharding."""
