"""Training-data operators: language ID, search, scoring, near-duplicates, extraction, packing, tokens.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
