"""Training-data operators (search, dedup, filtering, mixing, packing). Nothing outside this folder imports it."""
