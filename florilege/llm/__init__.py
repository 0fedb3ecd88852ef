"""Operators of a training-data pipeline: near copies, contamination, quality, secrets, language, packing, addresses, pages."""
