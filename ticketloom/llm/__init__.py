"""Training-data operators: scoring, encoding, search, deduplication, filters and scans."""
