"""Operators for preparing training text: near-duplicate search, filters, scans, deduplication and tokens."""
