"""Training-data operators: sharding, deduplication, filtering, formatting and scoring of text corpora."""
