"""Operators for large training-data corpora: search, privacy, decontamination, deduplication, sharding and tokens."""
