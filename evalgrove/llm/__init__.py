"""Corpus operators for training data: deduplication, filtering, tokenisation and packing."""
