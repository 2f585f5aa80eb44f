"""Operators of a training-data pipeline: deduplication, quality, tokenisation, packing, archives."""
