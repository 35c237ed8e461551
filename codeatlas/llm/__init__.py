"""Training-data operators: cleaning, deduplication, packing, filtering and mixing."""
