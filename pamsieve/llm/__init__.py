"""Training-data operators: dedup, joins, fingerprints, tokens, filters, packing and chat formatting.

Nothing outside this package imports it.
"""
