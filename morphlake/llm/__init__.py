"""Training-data operators: language ID, scoring, filtering, deduplication, mixing and packing."""
