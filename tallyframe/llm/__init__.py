"""Operators of a training-data pipeline (language, quality, tokens, duplicates, packing)."""
