"""Operators of a training-data pipeline: scoring, cleaning, deduplication, tokens, shards."""
