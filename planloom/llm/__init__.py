"""Operators for preparing training data: cleaning, deduplication, mixing, packing and formatting of corpora.

Nothing else in the package imports this subpackage.
"""
