"""Training-data operators: mixing, media columns, near-duplicates, toxicity,
licences, sharding, exact-substring dedup, top-k search, packing, quality.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
