"""Training-data operators: token counts, deduplication, packing, mixing, classifiers, secrets, search."""
