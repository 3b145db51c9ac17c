"""Training-data operators: cleaning, near duplicates, search, extraction, tokens, privacy, packing."""
