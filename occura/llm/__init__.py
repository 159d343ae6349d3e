"""Training-data operators: quality, language, deduplication, decontamination, packing and tokens."""
