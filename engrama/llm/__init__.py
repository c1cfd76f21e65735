"""Training-data operators: extraction, sharding, dedup, quality, packing. Nothing else in the library imports this."""
