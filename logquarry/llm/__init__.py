"""Operators for preparing training text: scores, links, searches, formats and encodings."""
