"""Training-data operators: sharding, decontamination, extraction, deduplication, quality, tokens, scoring.

Nothing else in the library imports this package.
"""
