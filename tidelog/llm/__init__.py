"""Operators of a training-data pipeline: tokens, packing, quality, toxicity, duplicates, language, nearest vectors."""
