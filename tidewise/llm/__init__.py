"""Operators for building training corpora: language, duplicates, vectors, tokens, shards, mixing, toxicity."""
