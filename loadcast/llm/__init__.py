"""Operators for building training data: scans, classifiers, dedup, search, mixing, sharding, packing.

Each module holds one operator with its general interface (frames in, frames
out) and the thin ``op*`` query that derives the registered columns from it.
Nothing outside this package imports it except the entry module.
"""
