"""Training-data operators: PII surrogates, decontamination, language ID, chat
formatting, near-duplicate search, substring dedup, mixing, WARC and sharding.

Nothing outside this subpackage imports it."""
