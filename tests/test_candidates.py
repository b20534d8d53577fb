"""What is broadcast when probes meet a catalogue, and both ways to join them."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lodestar import queries as Q
from lodestar.operators import candidates as J
from lodestar.operators.postings import postings
from lodestar.operators.query import analyze
from lodestar.plans.search import Catalog, pair
from lodestar.sources.catalog import queries_frame

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def broadcasts(df):
    """The texts of the subtrees that a plan broadcasts."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:+\-*()0-9]*", x)[0]) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


@pytest.mark.parametrize("name", ["candidates_delete", "candidates_rarest_gram", "candidates_exact"])
def test_postings_are_not_broadcast(spark, name):
    sent = broadcasts(Q.QUERIES[name](spark, DATA))
    assert sent and not any("Generate" in x and "part.parquet" in x for x in sent)


def test_records_are_not_broadcast(spark, tmp_path):
    cat = Catalog(Q.prepared(spark, DATA)).save(str(tmp_path / "records"))
    assert not any("FileScan" in x and "commercial_name_en" in x for x in broadcasts(pair(cat, analyze(Q.asked(spark)), False)))


def test_many_probes_meet_by_a_shuffle(spark, monkeypatch):
    cat = Q.prepared(spark, DATA).persist()
    asked = analyze(queries_frame(spark, ["smal widget", "redplate", "gizm0", "zzzzz"]))
    few = {tuple(r) for r in J.candidates(asked, cat, postings(cat)).collect()}
    monkeypatch.setattr(J.meet, "__defaults__", (0,))
    many = J.candidates(asked, cat, postings(cat))
    assert few and {tuple(r) for r in many.collect()} == few
    one = J.meet(spark.range(3).select(F.col("id").cast("string").alias("key")), postings(cat), ["key"])
    assert "SortMergeJoin" in one._jdf.queryExecution().executedPlan().toString() and not any("Range" in x for x in broadcasts(one))
    cat.unpersist()
