"""Operators of a training-data pipeline: near duplicates, filters, extraction, tokens and packing."""
