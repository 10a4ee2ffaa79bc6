"""Training-data operators: language ID, chat formatting, WARC, mixing, fingerprints,
top-k search, near-duplicates, sharding, BPE and substring dedup."""
