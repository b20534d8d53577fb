"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sampled(labels: DataFrame, label: str, bound: int, keep: Column) -> DataFrame:
    """doc_id, label: at most ``bound`` labelled ids that pass ``keep``, those
    with the smallest id hashes; of ids labelled twice the smaller label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    once = rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
