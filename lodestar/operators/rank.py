"""Ranking (RK1-RK8): windows over each query's scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.normalize import filled, pieces
from ..functions.similarity import pure_deletion

def _query(*order) -> W.WindowSpec:
    return W.Window.partitionBy("query_id").orderBy(*order)


def eligible() -> Column:
    """RK2's five rules for a candidate against the first one, ``top``."""
    gap, dist, top_dist = F.col("top.score") - F.col("score"), F.col("dist"), F.col("top.dist")
    headed = (dist < top_dist) & F.col("head_variant") & (F.col("head_raw") <= 2)
    words, top_words = F.size(pieces("base_norm")), F.size(pieces("top.base_norm"))
    deletion = ~pure_deletion("qc", "top.bc", "top.raw") & pure_deletion("qc", "bc", "raw") & (F.col("raw") <= F.col("top.raw")) & (gap <= 250)
    frame = headed & F.col("head_frame") & (gap <= 250)
    spelling = headed & (F.length("qc") >= 5) & (gap <= 900)
    pure_gap = (dist < top_dist) & (F.col("raw") <= 2) & (F.abs(F.length("qc") - F.length("bc")) == F.col("raw")) & (gap <= 120)
    many = (top_words > 1) & (words == 1) & (F.col("raw") < F.col("top.raw")) & (F.col("raw") <= 2) & (gap <= 350)
    return deletion | frame | spelling | pure_gap | many


def promote(scored: DataFrame) -> DataFrame:
    """RK1, RK2: ``pos`` by score, then the best eligible correction to the front."""
    rows = scored.withColumns({"name_key": F.collate(F.coalesce("commercial_name_en", F.lit("")), "UNICODE"), "dist": F.when(F.col("head_variant"), F.least("raw", "head_raw")).otherwise(F.col("raw"))})
    by_score = _query(F.desc("score"), "name_key", "candidate_id")
    rows = rows.withColumns({"pos": F.row_number().over(by_score), "top": F.first(F.struct("score", "raw", "dist", "bc", "base_norm")).over(by_score)})
    rows = rows.withColumn("corrects", F.col("brand_like") & (F.col("top.raw") != 0) & (F.col("pos") > 1) & eligible())
    best = F.row_number().over(_query(F.desc("corrects"), "dist", "weighted", F.desc("edge"), F.desc("positional"), F.desc("score"), "pos"))
    rows = rows.withColumn("front", F.col("corrects") & (best == 1))
    return rows.withColumn("pos", F.row_number().over(_query(F.desc("front"), "pos"))).drop("top", "corrects", "front", "dist", "name_key")


def lift_family(ranked: DataFrame) -> DataFrame:
    """RK4: behind an exact base, the other bases of its family."""
    rows = ranked.withColumn("top", F.first(F.struct("raw", "family_group_key", "base_group_key")).over(_query("pos")))
    related = (F.col("unreadable_mode") == "none") & (F.col("top.raw") == 0) & (F.col("family_group_key") == F.col("top.family_group_key")) & ~F.col("base_group_key").eqNullSafe(F.col("top.base_group_key"))
    group = F.when(F.col("pos") == 1, 0).when(related, 1).otherwise(2)
    return rows.withColumn("pos", F.row_number().over(_query(group, "pos"))).drop("top")


def best_of_base(ranked: DataFrame) -> DataFrame:
    """RK5: the first row of each base."""
    base = filled("base_group_key", "commercial_name_en", "candidate_id")
    first = F.row_number().over(W.Window.partitionBy("query_id", "base_id").orderBy("pos"))
    return ranked.withColumn("base_id", base).withColumn("nth", first).where("nth = 1").drop("nth", "base_id")


def top_k(ranked: DataFrame) -> DataFrame:
    """RK6: ``rank`` 1 to the query's limit."""
    return ranked.withColumn("rank", F.row_number().over(_query("pos"))).where(F.col("rank") <= F.col("result_limit")).drop("pos")


def rank(scored: DataFrame) -> DataFrame:
    return top_k(best_of_base(lift_family(promote(scored))))


def group_by_family(results: DataFrame, most: int = 6) -> DataFrame:
    """RK8: a row for each family in order of its best rank, with the first row
    of each base, at most ``most``."""
    key = filled("family_group_key", "base_group_key", "commercial_name_en")
    once = F.row_number().over(W.Window.partitionBy("query_id", "family", "base_group_key").orderBy("rank"))
    rows = results.withColumn("family", key).withColumn("nth", once).where("nth = 1")
    entry = F.struct("rank", "candidate_id", "base_group_key", "ingredient_key", "route_family", "commercial_name_en", "price_egp")
    grouped = rows.groupBy("query_id", "family").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_variants"), F.array_sort(F.collect_list(entry)).alias("variants"))
    return grouped.withColumn("variants", F.slice("variants", 1, most)).withColumn("displayed_rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy("first_rank")))
