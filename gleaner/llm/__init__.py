"""Operators for preparing training text: fingerprints, quality, URL rules,
near-duplicate joins, source mixing, token counts, sharding, vector search,
byte-level BPE and repeated-passage removal."""
