"""Operators of a training-data pipeline: token counts, filters, deduplication, packing."""
