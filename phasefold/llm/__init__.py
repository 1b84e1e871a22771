"""Training-data operators: dedup, search, decontamination, token counts,
toxicity, mixing, token output, near-dedup, licence scans, language ID.

Nothing outside this package imports it.
"""
