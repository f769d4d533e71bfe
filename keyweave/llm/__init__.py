"""Operators of a training-data pipeline: scoring, filtering, deduplication, tokens and packing.

Every operator takes a DataFrame of documents (``doc_id``, ``text`` and any further columns)
and plans its work with DataFrames; tasks handle Arrow batches. Nothing outside this package
imports it.
"""
