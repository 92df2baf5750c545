"""Operators of a training-data pipeline: deduplication, extraction, packing, tokens, search."""
