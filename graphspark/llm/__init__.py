"""Training-data operators: token counts, personal data, similarity joins, quality, mixing, sharding."""
