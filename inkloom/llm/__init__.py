"""Training-data operators: mixing, deduplication, counting, search, scoring and scanning."""
