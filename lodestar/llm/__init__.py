"""Training-data operators: scoring, filtering, deduplication, mixing, packing
and the file formats around them.

Nothing outside this package imports it. Every operator is a function from
DataFrames to a DataFrame; the thin registered queries are in ``queries``.
"""
