"""Operators for training-data corpora: deduplication, identification, tokenising, packing, extraction."""
