"""Operators that prepare text corpora: cleaning, deduplication, tokenising, packing."""
