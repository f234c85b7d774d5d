"""Training-data operators: scoring, licence and repetition scans, tokenisation, packing, joins and search."""
