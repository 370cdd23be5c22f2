"""Operators for training-data pipelines: search, deduplication, classification, packing, tokenizers."""
