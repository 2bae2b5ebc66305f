"""Fixed domain values: form codes, labels, keywords, aliases, regions."""
