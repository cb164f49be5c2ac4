"""Training-data operators: tokenising, filtering, deduplicating and packing documents.

Nothing outside this subpackage imports it.
"""
