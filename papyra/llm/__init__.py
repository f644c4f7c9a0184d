"""Training-data operators: tokenizing, mixing, fingerprints, filters, sharding, classifiers, joins."""
