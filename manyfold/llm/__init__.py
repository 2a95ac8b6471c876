"""Training-data operators: tokenizing, search, deduplication, filtering, extraction and mixing."""
