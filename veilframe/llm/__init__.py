"""Operators for building training corpora: mixing, secrets, near-dedup, classifiers,
quality rules, media columns, URL filters, substring dedup and packing.

Nothing else in the library imports this subpackage.
"""
