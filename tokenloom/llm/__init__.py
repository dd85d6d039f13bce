"""Operators for preparing training text: scoring, deduplication, extraction, tokens, packing.

Nothing outside this package imports it.
"""
