"""Training-data operators: dedup, filters, token files, packing and mixing."""
