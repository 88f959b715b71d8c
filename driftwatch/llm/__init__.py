"""Operators for training-data pipelines: duplicates, filters, archives, packing and language models."""
