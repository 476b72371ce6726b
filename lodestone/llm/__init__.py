"""Training-data operators: packing, search, tokens, secrets, dedup, classifiers."""
