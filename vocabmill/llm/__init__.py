"""Operators for preparing training data: tokens, filters, duplicates, packing.

Nothing else in the library imports this package; it can be deleted as a whole.
"""
