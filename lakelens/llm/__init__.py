"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator with its general interface; ``queries``
registers the thin queries over the synthetic tables.
"""
