"""Operators for training-data corpora: scoring, cleaning, duplicates, archives, packing."""
