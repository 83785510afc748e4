"""Operators for text corpora: quality, toxicity, secrets, duplicates, scoring, packing, encoding, language."""
