"""Corpus operators for training data: counting, packing, deduplication, extraction, scoring.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; Python code runs inside tasks, on Arrow batches, only.
"""
