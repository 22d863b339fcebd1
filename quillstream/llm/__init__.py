"""Training-data operators: mixing, near-duplicates, tokens, fingerprints, filters and classifiers."""
