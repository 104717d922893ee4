"""Operators for preparing training text: scoring, deduplication, filtering, search, packing."""
