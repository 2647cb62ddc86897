"""Operators that prepare training data: quality, deduplication, packing, scoring and archives."""
