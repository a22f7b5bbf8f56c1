"""Operators for preparing training text: filtering, deduplication, extraction, packing and formatting."""
