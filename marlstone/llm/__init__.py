"""Training-data operators: tokens, de-duplication, PII, quality, packing, archives, mixing, URL filters.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
