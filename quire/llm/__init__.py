"""Training-data operators: packing, decontamination, similarity join, quality, search, secrets, spans, PII, sharding, WARC."""
