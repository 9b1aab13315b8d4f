"""Training-data operators: tokenisation, search, packing, deduplication, models.

Nothing outside this subpackage imports it.
"""
