"""Training-data operators: packing, filtering, deduplication, scoring, encoding and scanning.

Nothing outside this folder imports it.
"""
