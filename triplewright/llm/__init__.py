"""Operators for text corpora: personal data, tokens, toxicity, media, near duplicates, HTML, packing."""
