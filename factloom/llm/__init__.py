"""Training-data operators: near-duplicates, classifiers, mixing, packing, URL filters,
fingerprints, token counts and secret scans. Nothing else in the library imports this."""
