"""Training-data operators: near-duplicates, classifiers, tokenisation, sharding, mixing and web archives."""
