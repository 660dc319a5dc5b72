"""Training-data operators: tokenised output, filters, deduplication, packing.

Nothing else in the library imports this subpackage.
"""
