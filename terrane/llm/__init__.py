"""Training-data operators: search, filters, tokenisation, web archives and deduplication."""
