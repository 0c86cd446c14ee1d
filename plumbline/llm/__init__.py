"""Operators for preparing training data: near-duplicates, search, quality, filters, mixing, tokens."""
