"""Operators for training-data pipelines: deduplication, quality, secrets, decontamination, tokens, archives."""
