"""Training-data operators: deduplication, packing, sharding, filtering, mixing, scoring and search.

Nothing outside this subpackage imports it.
"""
