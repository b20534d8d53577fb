"""Lodestar: a Spark-native engine for noisy catalogue retrieval.

A batch of free-text queries meets a catalogue of records; both are
DataFrames, and so is every result. See README.md for the layout.
"""
