"""Operators for training-data pipelines: cleaning, near-duplicates, mixing, tokens, archives, search."""
