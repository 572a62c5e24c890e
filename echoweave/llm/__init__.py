"""Training-data operators: deduplication, filtering, mixing, search and packing.

Nothing outside this package imports it, so it can be removed without
touching the rest of the library.
"""
