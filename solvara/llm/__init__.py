"""Training-data operators: filtering, deduplication, scoring, mixing, packing and search over corpus tables.

Nothing else in the library imports this subpackage.
"""
