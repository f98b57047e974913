"""Training-data operators: deduplication, mixing, archives, cleaning, tokenising.

Nothing else in the library imports this subpackage.
"""
