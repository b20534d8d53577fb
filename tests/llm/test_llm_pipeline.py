"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lodestar.llm import mixing, near_dup, packing
from lodestar.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    done = con.execute(ORACLES[name])
    columns = [c[0] for c in done.description]
    got = QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, done.fetchall()))


def test_stages_act_on_what_is_left(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= seen, name
        if name == "near_duplicates":
            components = near_dup.near_duplicates(docs).collect()
            assert len(components) == len({r["component_id"] for r in components})
        seen = kept
    packed = packing.pack(docs)
    assert packed.count() == docs.count()


def test_run_equals_the_stages_applied_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want


def test_mixing_stage_takes_what_the_report_says(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = "size(filter(split(text, '[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+'), x -> x <> ''))"
    assert mixing.mix(docs).selectExpr(f"sum({words})").first()[0] == mixing.mix_report(docs).selectExpr("sum(taken)").first()[0]
