"""Operators for large text corpora: decontamination, near-dedup, quality, repeats, token files, mixing, models.

Nothing else in the library imports this subpackage, and it imports nothing of the rest.
"""
