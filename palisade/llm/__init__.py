"""Training-data operators: filtering, deduplication, mixing, sharding, tokenising.

Nothing outside this subpackage imports it.
"""
