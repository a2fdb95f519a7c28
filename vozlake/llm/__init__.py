"""Training-data operators: deduplication, filtering, packing and audits of text corpora."""
