"""Batch search: queries x catalogue -> results and a summary of each query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import candidates, meet
from ..operators.decide import clarify, project, risk, summarize
from ..operators.postings import postings
from ..operators.query import analyze
from ..operators.rank import rank
from ..operators.score import score
from ..sources.catalog import prefix_danger, prepare_catalog, queries_frame, short_registry
from ..sources.shared import stored

#: Queries of a batch up to which they are broadcast, as only a side of checked
#: size is; larger batches meet the catalogue in blocks of about so many.
EXHAUSTIVE_QUERIES = 2000


@dataclass
class Catalog:
    """A prepared catalogue with its statistics and postings, all lazy."""

    records: DataFrame

    @classmethod
    def build(cls, raw: DataFrame) -> Catalog:
        return cls(prepare_catalog(raw))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(spark.read.parquet(path))

    def save(self, path: str) -> Catalog:
        """Writes the prepared records and goes on from the written table."""
        self.records.write.mode("overwrite").parquet(path)
        return Catalog(self.records.sparkSession.read.parquet(path))

    def cached(self) -> Catalog:
        """Keeps records and postings with the executors; what is lost is computed again."""
        self.records.persist()
        self.postings.persist()
        return self

    @cached_property
    def danger(self) -> DataFrame:
        return prefix_danger(self.records, 1)

    @cached_property
    def registry(self) -> DataFrame:
        return short_registry(self.records)

    @cached_property
    def postings(self) -> DataFrame:
        return postings(self.records)


def pair(catalog: Catalog, queries: DataFrame, exhaustive: bool = True) -> DataFrame:
    """Every analysed query with the records to score it against: all of them,
    or, where not ``exhaustive``, those that share a key with it."""
    if exhaustive:
        n = queries.count()
        if n <= EXHAUSTIVE_QUERIES:
            return catalog.records.crossJoin(F.broadcast(queries))
        blocks = queries.repartition(-(-n // EXHAUSTIVE_QUERIES))
        return catalog.records.crossJoin(blocks.hint("shuffle_replicate_nl"))
    queries = stored(queries, "asked")
    found = stored(candidates(queries, catalog.records, catalog.postings), "candidates")
    # Records are wider than their files tell, so they are never broadcast.
    return meet(queries, found, ["query_id"], EXHAUSTIVE_QUERIES).join(catalog.records.hint("merge"), "candidate_id")


@dataclass
class Answer:
    results: DataFrame
    summary: DataFrame

    def write(self, path: str, format: str = "parquet") -> None:
        """SNK1."""
        self.results.write.mode("overwrite").format(format).save(f"{path}/results")
        self.summary.write.mode("overwrite").format(format).save(f"{path}/summary")


def search_batch(catalog: Catalog, queries: DataFrame, exhaustive: bool = True) -> Answer:
    """``queries``: query_id, text, unreadable_mode, ending_fragment, result_limit.
    Results don't depend on the size of the batch."""
    asked = analyze(queries)
    pairs = pair(catalog, asked, exhaustive)
    risks = risk(asked, catalog.danger, catalog.registry)
    results = project(clarify(rank(score(pairs)), risks))
    counts = pairs.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    return Answer(results, summarize(asked, results, risks, counts))


def search(spark: SparkSession, catalog: Catalog, text: str, limit: int = 20, mode: str = "none", ending: str = "") -> Answer:
    """The single query, as a batch of one."""
    return search_batch(catalog, queries_frame(spark, [{"text": text, "limit": limit, "unreadable_mode": mode, "ending_fragment": ending}]))
