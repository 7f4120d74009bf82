"""Training-data operators: deduplication, archives, privacy, safety, packing.

Nothing outside this subpackage imports it.
"""
