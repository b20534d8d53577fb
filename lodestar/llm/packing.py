"""Packing into optimal length buckets.

The global histogram of lengths is aggregated; dynamic programming over it
chooses the bucket boundaries that minimise padding; inside each bucket,
batches are filled up to a token budget.

The histogram has one bin for each distinct length, and the boundaries are optimal
on it whatever their number: lengths that differ add up to at least half the
square of their number, so it is at most about the root of twice the tokens. The
programme is solved by divide and conquer (the best origin moves up with j), a
level of it at once, so a bucket costs n log n for n lengths.

A document's place in its bucket comes from prefix sums over hash slots, so no
task orders a whole bucket: a slot holds about SLOT_ROWS documents of it however
large the bucket is; slots go by id and text, so ids that are null or repeat are
spread as well. Rows with equal (doc_id, text) are interchangeable.

Edge cases: a null or empty text has length 0 and costs the smallest bucket's
padding; one longer than the budget gets a batch of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import n_words, stored

#: Origins that the programme looks at in one numpy step.
BATCH = 1 << 20
SLOT_ROWS = 20_000


def _best_origins(cost: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j > 0 the least cost[i] + lengths[j] * (rows[j + 1] - rows[i + 1])
    over i < j, and the first i that gives it. That i never falls as j grows: so
    the middles of all open ranges of j are solved together, each over the
    origins between those of its neighbours already solved."""
    n = len(lengths)
    least, origin = np.full(n, np.inf), np.zeros(n, np.int64)
    lo, hi, first, last = (np.array([x]) for x in (1, n - 1, 0, n - 2))
    while len(lo):
        mid = (lo + hi) // 2
        sizes = np.minimum(last, mid - 1) - first + 1
        starts = np.cumsum(sizes) - sizes
        # A group of ranges whose origins fill a batch.
        for part in np.split(np.arange(len(mid)), np.flatnonzero(np.diff(starts // BATCH)) + 1):
            size, at = sizes[part], starts[part] - starts[part[0]]
            i = np.arange(size.sum()) - np.repeat(at, size) + np.repeat(first[part], size)
            j = np.repeat(mid[part], size)
            options = cost[i] + lengths[j] * (rows[j + 1] - rows[i + 1])
            best = np.minimum.reduceat(options, at)
            hit = np.where(options == np.repeat(best, size), i, n)
            least[mid[part]], origin[mid[part]] = best, np.minimum.reduceat(hit, at)
        lo, hi, first, last = np.append(lo, mid + 1), np.append(mid - 1, hi), np.append(first, origin[mid]), np.append(origin[mid], last)
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return least, origin


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the sorted ``lengths`` that
    minimise sum(count * bound). cost[k][j] = min_i cost[k-1][i] + bound_j * rows(i, j)."""
    n = len(lengths)
    rows = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    cost, back = lengths * rows[1:], []
    for _ in range(min(buckets, n) - 1):
        least, origin = _best_origins(cost, lengths, rows)
        better = least < cost
        back.append(np.where(better, origin, -1))
        cost = np.where(better, least, cost)
    bounds, j = [], n - 1
    for origin in reversed(back):
        bounds.append(int(lengths[j]))
        if origin[j] < 0:
            break
        j = int(origin[j])
    else:
        bounds.append(int(lengths[j]))
    return sorted(set(bounds))


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    bins = lengths.groupBy("n_tokens").agg(F.count("*").alias("n"))
    got = np.array([tuple(r) for r in bins.orderBy("n_tokens").collect()], dtype=np.int64).reshape(-1, 2)
    return got[:, 0].astype(np.float64), got[:, 1]


def pack(docs: DataFrame, buckets: int = 12, budget: int = 16_384, length=None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, place, padding of every
    document; (bucket, batch) names a batch of at most ``budget`` padded tokens.

    ``length``: a Column; words and one end token if not given."""
    lengths = stored(docs.select("doc_id", (n_words(F.col("text")) + 1 if length is None else length).cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("hash")), "packing-lengths")
    values, counts = histogram(lengths)
    bounds = best_boundaries(values, counts, buckets) if len(values) else [1]
    slots = max(1, int(counts.sum()) // SLOT_ROWS + 1)
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    rows = lengths.withColumn("bucket", bucket).withColumn("slot", F.pmod("hash", F.lit(slots)).cast("int"))
    before = W.Window.partitionBy("bucket").orderBy("slot").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = rows.groupBy("bucket", "slot").agg(F.count("*").alias("n")).select("bucket", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.Window.partitionBy("bucket", "slot").orderBy("doc_id", "n_tokens", "hash"))
    tokens = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    placed = rows.withColumn("_i", inside).join(bases, ["bucket", "slot"]).withColumn("_i", F.col("_i") - 1 + F.col("base"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    return placed.withColumn("bucket_tokens", tokens).select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_i") / room).cast("long").alias("batch"), F.pmod(F.col("_i"), room).cast("long").alias("place"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )
