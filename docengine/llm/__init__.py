"""Training-data operators: dedup, decontamination, quality, privacy, mixing, search, formatting.

Nothing else in the library imports this subpackage.
"""
