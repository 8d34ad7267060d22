"""Training-data operators: deduplication, packing, filters, scans, scoring and archives."""
