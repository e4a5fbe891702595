"""Training-data operators: packing, secret scans, decontamination, toxicity, token output,
language-model scoring, audio features, near-duplicates, licence digests and sharding.

Nothing outside this subpackage imports it.
"""
