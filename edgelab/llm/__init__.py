"""Operators for large training-data pipelines: archives, decontamination, filtering, near-duplicates, tokenisation.

Nothing outside this subpackage imports it; it can be deleted and the rest of the library still works.
"""
