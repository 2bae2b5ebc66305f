"""Training-data operators: deduplication, tokens, sharding, mixing, quality, search."""
