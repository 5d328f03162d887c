"""Operators for preparing training text: language, tokens, pages, quality, mixing, duplicates, toxicity, personal data."""
