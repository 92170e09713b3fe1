"""Training-data operators: quality, deduplication, decontamination, tokens, secrets and languages."""
