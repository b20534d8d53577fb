"""Mixing against its SQL and a plain loop; packing against exhaustive search."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, size int, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], SCHEMA)


def some(n=300, seed=1):
    rng = random.Random(seed)
    sources = ["src0"] * 6 + ["b", "a", "é", None]
    return [(i, rng.choice([None, "", " \n"]) if rng.random() < 0.05 else "w " * rng.randrange(1, 60), rng.choice(sources)) for i in range(n)]


def brute(rows):
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    amounts = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(amounts.values())
    free = set(names)
    while left > 1e-9 and free:  # share the excess again by weight until none is above
        total = sum(weights[s] for s in free)
        for s in free:
            target[s] += left * weights[s] / total
        left = sum(max(0, target[s] - 2 * amounts[s]) for s in free)
        for s in list(free):
            if target[s] >= 2 * amounts[s]:
                target[s] = 2.0 * amounts[s]
                free.discard(s)
    out = {}
    for s in names:
        name = lambda i, t: f"{'' if i is None else i} {hashlib.md5((t or '').encode()).hexdigest()}"
        own = sorted((hashlib.md5(name(i, t).encode()).hexdigest()[:12], i, size(t)) for i, t, x in rows if x == s)
        whole = int((target[s] + 1e-6) // amounts[s]) if amounts[s] else 0
        rest, upto = target[s] - whole * amounts[s], 0
        for _, i, n in own:
            upto += n
            out[i] = (n, amounts[s], pytest.approx(target[s]), n * (whole + (upto <= rest + 1e-6)))
    return out


def test_mix_equals_a_plain_loop_and_comes_near(spark):
    rows = some()
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix_report(frame(spark, rows)).collect()}
    assert got == brute(rows)
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        taken = sum(v[3] for i, v in got.items() if source[i] == s)
        target = next(v[2] for i, v in got.items() if source[i] == s)
        assert target - 60 <= taken <= target + 1e-6
    assert all(v[3] <= 2 * v[0] for v in got.values())


def test_mix_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = some(seed=2)
    pandas = frame(spark, rows).toPandas()
    con = duckdb.connect()
    con.register("documents", pandas)
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    assert sorted(tuple(r) for r in mixing.mix_report(frame(spark, rows)).collect()) == want


def test_mixture_has_the_reported_copies(spark):
    rows = some(80, 3)
    df = frame(spark, rows)
    size = lambda t: len((t or "").split())
    report = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(df).collect() if r["size"]}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.where("size(split(trim(coalesce(text, '')), '[ \\n]+')) > 0").groupBy("doc_id").count().collect()}
    assert {i: c for i, c in counts.items() if size(dict((a, b) for a, b, _ in rows)[i])} == {i: c for i, c in report.items() if c}


def test_mix_edges(spark):
    assert mixing.mix_report(frame(spark, []).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_report(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
    tied = mixing.mix_report(frame(spark, [(1, "a b", "x"), (1, "a b", "x"), (2, "c", "y")])).collect()
    assert len({r["taken"] for r in tied if r["doc_id"] == 1}) == 1


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("buckets", [1, 2, 3, 4, 9])
def test_boundaries_are_optimal(buckets):
    rng = random.Random(buckets)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 100), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 50) for _ in lengths]
        got = packing.best_boundaries(np.array(lengths, float), np.array(counts), buckets)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
        assert len(got) <= buckets and padding(lengths, counts, got) == best


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 50)
    rng = random.Random(5)
    rows = [(i, "w " * min(2000, int(rng.paretovariate(1) * 5)), "s") for i in range(600)] + [(1000, None, "s"), (1001, "", "s"), (7, "a b", "s"), (7, "a b", "s")]
    got = packing.pack(frame(spark, rows), buckets=6, budget=1024).collect()
    assert len(got) == len(rows)
    places, batches = set(), {}
    for r in got:
        assert 0 <= r["padding"] == r["bucket_tokens"] - r["n_tokens"]
        places.add((r["bucket"], r["batch"], r["place"]))
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_tokens"])
    assert len(places) == len(rows)  # no two documents share a place
    assert all(sum(b) <= 1024 or len(b) == 1 for b in batches.values())
    for bucket in {b for b, _ in batches}:  # all batches of a bucket but the last are full
        sizes = [len(batches[bucket, n]) for n in range(max(n for b, n in batches if b == bucket) + 1)]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def test_null_ids_come_near_the_target(spark):
    rows = [(None, f"{'w ' * 10}x{i}", "s") for i in range(400)]
    got = mixing.mix_report(frame(spark, rows)).collect()
    assert {r["target"] for r in got} == {1.5 * 4400} and 6500 < sum(r["taken"] for r in got) <= 6600


def test_columns_of_any_name_are_carried(spark):
    names = ["_hash", "whole", "below", "_s", "copies", "_copy", "key", "row", "rows", "hash"]
    df = frame(spark, some(40, 5)).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert {tuple(r)[-len(names) :] for r in got.collect()} == {tuple(range(len(names)))}
    assert got.count() == mixing.mix(df.drop(*names)).count() > 0


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = some(200, 6) + [(1000 + i, "w " * 7, f"s{i}") for i in range(30)]
    want = sorted(map(tuple, mixing.mix_report(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "SMALL_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix_report(frame(spark, rows)).collect())) == want


def test_null_and_equal_ids_are_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 20)
    got = packing.pack(frame(spark, [(None, f"a b {i}", "s") for i in range(100)] + [(5, f"a {i}", "s") for i in range(50)])).collect()
    assert len({(r["bucket"], r["batch"], r["place"]) for r in got}) == len(got) == 150


def test_every_row_has_a_place(spark):
    rows = [(i, "w " * i, "s") for i in range(100)]
    got = packing.pack(frame(spark, rows), buckets=3).collect()
    assert len(got) == 100 and all(r["padding"] >= 0 and r["n_tokens"] == r["doc_id"] + 1 for r in got)


def test_many_lengths_and_an_outlier_keep_exact_boundaries(spark):
    rng = np.random.default_rng(7)
    lengths = np.append(np.arange(1, 5001), 4_000_000)
    counts = np.append(rng.integers(1, 5, 5000), 1)
    df = spark.createDataFrame([(n, c) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)], "n long, c int")
    df = df.selectExpr("n as doc_id", "'' as text", "explode(array_repeat(n, c)) as n")
    got = packing.pack(df, buckets=4, length=F.col("n")).agg(F.sum("padding"), F.count("*")).first()
    # The outlier has a bucket of its own; the others are cut by a plain programme.
    rows = np.concatenate([[0], np.cumsum(counts[:-1])])
    cost = lengths[:-1] * rows[1:]
    for _ in range(2):
        cost = np.array([min(cost[j], (cost[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1])).min(initial=cost[j])) for j in range(5000)])
    assert tuple(got) == (cost[-1] - (lengths * counts)[:-1].sum(), counts.sum())
