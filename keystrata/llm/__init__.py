"""Operators for preparing training text: privacy, mixing, extraction, deduplication and filters."""
