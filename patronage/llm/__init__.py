"""Operators for training-data pipelines: deduplication, scoring, tokenising, mixing, extraction."""
