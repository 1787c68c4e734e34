"""Operators for preparing training text: mixing, packing, deduplication, filtering, scoring and binary output."""
