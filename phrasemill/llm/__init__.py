"""Operators of a training-data pipeline: tokenising, deduplication, language, secrets, scoring, packing."""
