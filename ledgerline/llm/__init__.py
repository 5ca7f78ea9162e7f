"""Operators of a training-data pipeline: licence scans, chat formatting,
exact search, similarity joins, toxicity, mixing, packing, substring
deduplication and token counts.  Nothing outside this folder imports it."""
