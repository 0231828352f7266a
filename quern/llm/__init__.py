"""Training-data operators: deduplication, search, mixing, extraction and scoring."""
