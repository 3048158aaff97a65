"""Training-data operators: scoring, extraction, mixing, filtering and deduplication of text corpora."""
