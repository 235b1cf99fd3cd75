"""Operators for training-data pipelines: formatting, cleaning, deduplication, tokens, search."""
