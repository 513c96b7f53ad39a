"""Operators of a training-data pipeline: cleaning, deduplication, tokenising and packing of documents.

Nothing else in the library imports this subpackage.
"""
