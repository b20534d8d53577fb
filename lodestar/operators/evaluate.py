"""Retrieval metrics (E1-E9) over labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Gains of the relevance levels: product, base, ingredient (our choice).
GAINS = {"product": 3, "base": 2, "ingredient": 1}


def judge(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Each result with its relevance to the labelled target; results of
    queries without a label are left out."""
    targets = labels.select("query_id", "target_candidate_id", "target_base", "target_ingredient")
    rel = (
        F.when(F.col("candidate_id") == F.col("target_candidate_id"), GAINS["product"]).when(F.col("base_group_key") == F.col("target_base"), GAINS["base"])
        .when(F.col("ingredient_key") == F.col("target_ingredient"), GAINS["ingredient"]).otherwise(0)
    )
    return results.join(targets, "query_id").select(*results.columns, rel.alias("relevance"))


def per_query(judged: DataFrame, labels: DataFrame, depth: int = 20, least: int = 2) -> DataFrame:
    """E1-E7 for each labelled query; those without results score 0. A result
    counts as a hit from relevance ``least``; nDCG is graded."""
    rows = judged.where(F.col("rank") <= depth)
    hit = F.col("relevance") >= least
    so_far = W.Window.partitionBy("query_id").orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0)
    ideal = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank"))
    rows = rows.withColumns({"precision": F.sum(hit.cast("int")).over(so_far) / F.col("rank"), "best_place": ideal})
    gain = lambda place: F.sum(F.col("relevance") / F.log2(F.col(place) + 1))
    found = rows.groupBy("query_id").agg(
        *[F.max((hit & (F.col("rank") <= k)).cast("int")).alias(f"hit_{k}") for k in (1, 5, 10, 20)], F.max(F.when(hit, 1 / F.col("rank"))).alias("rr"),
        F.avg(F.when(hit, F.col("precision"))).alias("ap"), (gain("rank") / F.when(gain("best_place") > 0, gain("best_place"))).alias("ndcg"),
    )
    names = ["hit_1", "hit_5", "hit_10", "hit_20", "rr", "ap", "ndcg"]
    return labels.select("query_id").join(found, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in names])


def metrics(scores: DataFrame) -> DataFrame:
    """Means over the queries: hit@1/5/10/20, MRR, MAP, nDCG."""
    return scores.agg(*[F.avg(f"hit_{k}").alias(f"hit_{k}") for k in (1, 5, 10, 20)], F.avg("rr").alias("mrr"), F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"))


def safety(results: DataFrame, summary: DataFrame, labels: DataFrame) -> DataFrame:
    """For each labelled query, whether approximate evidence never looks
    exact, ambiguous queries ask, expected warnings show, and unknown words give
    no confident result."""
    rows = results.groupBy("query_id").agg(
        F.bool_or(F.col("matched_signals").rlike(r"(^|\|)exact_") & (F.col("raw_edit_distance") > 0) & (F.col("rank") == 1)).alias("fuzzy_as_exact"),
        F.flatten(F.collect_set(F.split("warnings", r"\|"))).alias("shown"),
    )
    out = labels.join(rows, "query_id", "left").join(summary.select("query_id", F.col("needs_clarification").alias("asks")), "query_id", "left")
    asks, some = F.coalesce("asks", F.lit(False)), F.col("shown").isNotNull()
    return out.select(
        "query_id", (~F.coalesce("fuzzy_as_exact", F.lit(False))).alias("fuzzy_not_exact"), (~F.coalesce("must_clarify", F.lit(False)) | asks).alias("ambiguous_asks"),
        F.coalesce(F.size(F.array_except("expected_warning", "shown")) == 0, F.col("expected_warning").isNull()).alias("warnings_shown"), (~F.coalesce("must_be_empty_or_unconfident", F.lit(False)) | ~some | asks).alias("unknown_unsure"),
    )
