"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 48-bit hash of its id and text. A source's budget is met
by all documents whose hash is below a threshold. The threshold is found without
sorting: sizes are summed by source and by the leading 12 bits of the hash, the
bucket in which the budget runs out is refined by the next 12 bits, and so on.
Only that bucket's rows are read again, and no histogram holds more than 4,096
rows for a source.

A target above the source's own size nests: whole copies of the source first,
and a threshold for what is left.

All that is known of sources stays in tables of a row a source. Up to
SMALL_SOURCES of them are broadcast to the documents; of more, only those that hold
a thousandth of all documents, and the others meet theirs by a shuffle.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is
a source of its own, ordered last; rows with equal ids and texts have equal hashes
and are taken together, rows that share an id (or its absence) alone are not; an
empty table gives no rows; other columns are carried by ``mix``, whatever their
names, and never consulted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import join_groups, n_words, stored

LEVELS, BITS = 4, 12
#: Rows of per-source figures up to which they are joined by broadcast.
SMALL_SOURCES = 10_000


def _key() -> Column:
    """The source as a string that is never null."""
    return F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source"))).alias("key")


def _hash() -> Column:
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long").alias("hash")


def water_fill(totals: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``totals`` (key, source, amount, rows) with each source's target: in proportion
    to the weights, which repeat in the order of sources, and together ``share`` times
    all amounts; none above ``cap`` times its own, the excess of capped sources
    being shared again by weight among the others."""
    place = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1)
    # A row a source, without a partition: sources are few, documents are not.
    rows = totals.select("*", place.alias("place")).select("*", weight.alias("weight")).withColumn("full", cap * F.col("amount") / F.col("weight"))
    fuller = W.Window.orderBy("full", "place").rowsBetween(W.Window.unboundedPreceding, -1)
    every = W.Window.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    left = share * F.sum("amount").over(every) - cap * F.coalesce(F.sum("amount").over(fuller), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fuller), F.lit(0)))
    rows = rows.withColumn("level", level)
    # The level of the first source that isn't filled up is that of all after it.
    found = F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.struct("full", "place"))).over(every)
    target = F.least(cap * F.col("amount"), F.coalesce(F.col("found") * F.col("weight"), cap * F.col("amount")))
    return rows.withColumn("found", found).select("key", "amount", "rows", F.when(F.col("amount") > 0, target).otherwise(0.0).alias("target"))


def _met(rows: DataFrame, figures: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the figures of their sources; every source has some."""
    if few:
        return rows.join(F.broadcast(figures), "key")
    return join_groups(rows, figures, "key", "rows")


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame, bool]:
    """(sizes, cuts, few). sizes: doc_id, key, size, hash of every document. cuts,
    a row for each source's key: its rows, size and target, how many whole copies to
    take, and the hash below which a document is taken once more."""
    sizes = stored(docs.select("doc_id", _key(), "source", n_words(F.col("text")).alias("size"), _hash()), "mixing-sizes")
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("amount"), F.count("*").alias("rows"))
    state = water_fill(totals, weights, share, cap)
    whole = F.when(F.col("amount") > 0, F.floor(F.col("target") / F.col("amount"))).otherwise(0).cast("int")
    state = state.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("amount"))
    state = stored(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("amount") > 0), "mixing-sources")
    few = state.count() <= SMALL_SOURCES
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        cut = state.where("open").select("key", "rows", "left", "prefix")
        inside = _met(sizes.select("key", "size", "hash"), cut, few).where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        bucket = inside.groupBy("key", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(W.Window.partitionBy("key").orderBy("bucket"))
        over = bucket.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        first = over.groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("first"))
        state = state.join(first, "key", "left")
        # A budget that covers the whole bucket closes at its end; others are refined further.
        covered = F.when(F.col("open"), (F.col("prefix") + 1) * (1 << shift + BITS)).otherwise(F.col("prefix"))
        new = F.col("open") & F.col("first").isNotNull()
        state = stored(state.select(
            "key", "amount", "rows", "target", "whole", F.when(new, F.col("left") - F.col("first.before")).otherwise(F.col("left")).alias("left"),
            F.when(new, F.col("first.bucket")).otherwise(covered).alias("prefix"), new.alias("open"),
        ), "mixing-sources")
    return sizes, state.select("key", "rows", F.col("amount").alias("source_size"), "target", "whole", F.when(F.col("amount") > 0, F.col("prefix")).otherwise(0).alias("below")), few


def _copies() -> Column:
    return F.col("whole") + (F.col("hash") < F.col("below")).cast("int")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes, cuts, few = plan(docs, **options)
    return _met(sizes, cuts, few).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: ``docs`` with each row as often as it is taken."""
    _, cuts, few = plan(docs, **options)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _key(), _hash())
    picked = _met(rows, cuts.select("key", "rows", "whole", "below"), few).withColumn("copies", _copies()).where("copies > 0")
    return picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))), 1, 12) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source),
k AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS r,
         coalesce(sum(source_size) OVER o, 0) AS capped, coalesce(sum(w) OVER o, 0) AS used
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT min_by(level, r) AS level FROM (
    SELECT r, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - 2.0::DOUBLE * capped) / ((SELECT sum(w) FROM s) - used) AS level FROM k)
  WHERE level <= r),
t AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE * source_size, level * w) ELSE 0.0::DOUBLE END AS target
  FROM s, l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
