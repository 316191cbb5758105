"""Operators that prepare training text: deduplication, scoring, extraction and tokenization."""
