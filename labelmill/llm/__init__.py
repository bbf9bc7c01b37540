"""Training-data operators: packing, mixing, near-duplicates, classifiers, search and output."""
