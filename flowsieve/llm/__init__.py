"""Operators for preparing training data: tokens, duplicates, packing, pages, languages."""
