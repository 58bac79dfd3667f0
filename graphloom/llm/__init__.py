"""Training-data operators: scoring, near-duplicates, tokens, packing, scans.

Nothing outside this subpackage imports it.
"""
