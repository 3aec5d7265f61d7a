"""Operators for training-data pipelines: archives, quality, dedup, encoding, packing, sharding.

Nothing else in the library imports this subpackage.
"""
