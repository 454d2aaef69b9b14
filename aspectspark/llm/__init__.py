"""Training-data operators: quality rules, tokenization, line and byte
dedup, nearest neighbours, mixing, personal data, licenses, URL filters and
near-duplicates.  Nothing outside this subpackage imports it."""
