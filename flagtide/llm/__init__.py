"""Training-data operators: deduplication, filtering, tokenising, packing, archives."""
