"""Fingerprints of documents and their edits, and the table search."""

import hashlib
import random

import numpy as np

from lodestar.llm import fingerprints as fp


def test_edits_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [None, "", "x", "Ünï cödé text é " * 40] + [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 300))) for _ in range(60)] + ["y" * 50_000]
    ids = rng.sample(range(0, 5000, 10), len(texts))
    df = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, hi string")
    got = {r["doc_id"]: r for r in fp.report(df).collect()}
    order = sorted(zip(ids, texts, strict=True))
    prints = fp.simhash([t for _, t in order])
    for n, (i, text) in enumerate(order):
        following, k = order[(n + 1) % len(order)][1] or "", len(text or "") // 4
        edit = (text or "")[: len(text or "") - k] + following[:k]
        other = fp.simhash([edit])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text or ""), hashlib.sha256(edit.encode()).hexdigest())
        assert r["fingerprint"] == prints[n].tobytes().hex() and r["edited_fingerprint"] == other[0].tobytes().hex()
        assert r["near_edited"] == fp.likeness(prints[n : n + 1], other)[0]
        assert r["near_next"] == fp.likeness(prints[n : n + 1], prints[(n + 1) % len(order)][None])[0]
        near = (np.bitwise_count(prints ^ prints[n]).sum(axis=1) <= 3).sum() - 1
        assert r["n_near"] == (near if i % 100 == 0 else None)


def test_search_finds_every_neighbour(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, (30, 2))
    rows = [tuple(b) for b in base.tolist()]
    for hi, lo in base.tolist():
        for _ in range(20):
            x = [hi, lo]
            for bit in rng.choice(128, rng.integers(1, 6), replace=False).tolist():
                half, at = divmod(bit, 64)
                v = (x[half] & (1 << 64) - 1) ^ (1 << at)
                x[half] = v - (1 << 64) if v >> 63 else v
            rows.append(tuple(x))
    df = spark.createDataFrame(rows, "hi long, lo long")
    array = np.array(rows).view(np.uint64)
    for r in fp.count_near(df, df).collect():
        assert r["n_near"] == (np.bitwise_count(array ^ np.array([r["hi"], r["lo"]]).view(np.uint64)).sum(axis=1) <= 3).sum()


def test_weights_and_ties():
    assert (fp.simhash([None, "", " \n"]) == 0).all()
    a, b = fp.simhash(["same words here", "SAME\twords  here"])
    assert (a == b).all()


def test_ties_single_and_empty(spark):
    one = spark.createDataFrame([(3, "abcd efgh")], "doc_id long, text string")
    assert fp.fingerprint_edits(one).first()["near_next"] == 1.0
    twice = spark.createDataFrame([(3, "b b b b"), (3, "a a a a"), (None, "c c c c")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fp.fingerprint_edits(twice).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([("None", sha("c c c " + "a")), ("3", sha("a a a " + "b")), ("3", sha("b b b " + "c"))])
    assert fp.report(one.limit(0)).count() == 0


def test_many_null_and_equal_ids_give_a_row_each(spark):
    df = spark.createDataFrame([(None, f"n{i} x") for i in range(900)] + [(3, f"s{i} y") for i in range(300)] + [(i, f"t{i}") for i in range(10, 60)], "doc_id long, text string")
    got = fp.fingerprint_edits(df.repartition(5)).collect()
    assert len(got) == 1250 and sum(r["doc_id"] is None for r in got) == 900 and sum(r["doc_id"] == 3 for r in got) == 300
