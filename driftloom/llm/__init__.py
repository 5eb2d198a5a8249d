"""Operators for preparing training data: tokens, duplicates, languages, vectors, packing and shards."""
