"""Training-data operators: scoring, deduplication, tokenization, packing, archives and vector search."""
