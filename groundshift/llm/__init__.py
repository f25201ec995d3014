"""Training-data operators: packing, PII, token counts, near-duplicates, language ID, ANN, media, BPE, WARC, URL rules."""
