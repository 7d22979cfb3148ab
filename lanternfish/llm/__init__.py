"""Operators on corpora of code and text; nothing outside this package depends on it."""
