"""Posting tables (I1-I18): one long table (kind, key, candidate_id). The first
character index of the original is never read and isn't built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import deletes, max_deletes, ngrams, phonetic, prefixes, suffix_keys
from ..functions.normalize import norm, tokens

EXACT = ("nn", "c", "arn", "arc", "bn", "bc", "ingn", "ingc")
GRAMMED = ("c", "arc", "bc", "ingc")


def _all(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts))


def keys_by_kind() -> dict[str, Column]:
    """The array of keys that a prepared record has in each index."""
    long_enough = lambda a: F.filter(a, lambda k: F.length(k) >= 3)
    headed = lambda a: F.when(F.col("head_family") & (F.col("headc") != ""), a)
    words = tokens(norm(F.concat_ws(" ", "commercial_name_en", "base_group_key", "ingredient_key", "scientific_name")))
    return {
        "exact": F.array(*EXACT), "prefix": _all([prefixes(c, 2, 12) for c in EXACT]), "grams": _all([ngrams(c, 3) for c in GRAMMED]), "grams4": _all([ngrams(c, 4) for c in GRAMMED]),
        "suffix": _all([suffix_keys(c) for c in GRAMMED]), "token": words, "skeleton": F.array("sk"), "skeletonPrefix": prefixes("sk", 2, 10), "baseExact": F.array("bc"),
        "baseLength": F.array(F.when(F.col("bc") != "", F.length("bc").cast("string"))), "delete": long_enough(deletes("bc", max_deletes("bc"))), "phonetic": F.array("ph"),
        "phoneticPrefix": prefixes("ph", 3, 12), "headExact": headed(F.array("headc")), "headLength": headed(F.array(F.length("headc").cast("string"))),
        "headPhonetic": headed(F.array(phonetic("headc"))), "headDelete": headed(long_enough(deletes("headc", 2))),
    }


def postings(prepared: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Distinct (kind, key, candidate_id) of the wanted indexes."""
    table = keys_by_kind()
    one = [F.struct(F.lit(k).alias("kind"), F.filter(F.array_distinct(table[k]), lambda x: x.isNotNull() & (x != "")).alias("keys")) for k in kinds or table]
    lists = prepared.select("candidate_id", F.explode(F.array(*one)).alias("p")).select("candidate_id", "p.kind", F.explode("p.keys").alias("key"))
    return lists.select("kind", "key", "candidate_id")


def write_postings(prepared: DataFrame, path: str) -> None:
    """The table on disk, a folder for each kind, clustered by key."""
    postings(prepared).repartition("kind", "key").sortWithinPartitions("kind", "key").write.partitionBy("kind").mode("overwrite").parquet(path)


def document_frequency(posted: DataFrame) -> DataFrame:
    """A4."""
    return posted.groupBy("kind", "key").agg(F.count("*").alias("df"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
