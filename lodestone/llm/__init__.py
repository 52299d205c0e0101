"""Training-data operators: cleaning, deduplication, filtering, sharding and tokenising.

Nothing outside this subpackage imports it.
"""
