"""Connected components of an undirected graph by alternating large and small
stars (Kiveris et al., 2014): edges only, no task ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stored


#: Edges of a node beyond which they are split among tasks: some 16 MB.
WIDE = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of ``edges`` (a, b: long) that aren't the
    smallest of their component; root is the smallest. Loops, repeated and
    null edges change nothing; no edges give no rows."""

    def stars(df: DataFrame) -> tuple[DataFrame, DataFrame, tuple]:
        """The edges stored, both ways round, and (their number, a checksum, the widest node's)."""
        kept = stored(df.where("u > v").distinct(), "stars")
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = both.groupBy("u").agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("h"))
        return kept, both, tuple(nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.max("n")).first())

    def joined(rows: DataFrame, mark: tuple) -> DataFrame:
        """The rows u, v with m: the least of u and all its v."""
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        if mark[2] > WIDE:
            return join_groups(rows, least, "u", "degree", total=mark[0])
        return rows.join(least, "u")

    now, both, mark = stars(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null"))
    while mark[0]:
        large = joined(both, mark).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = joined(large, mark).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now, both, new = stars(small)
        if new[:2] == mark[:2]:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
