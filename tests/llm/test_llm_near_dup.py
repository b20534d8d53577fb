"""SimHash near-duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lodestar.llm import graph
from lodestar.llm import near_dup as nd
from lodestar.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, fp string, class_size int"


def brute(texts: dict) -> dict:
    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {k: fingerprint(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (f"{p:016x}", find(k)) for k, p in prints.items()}


def test_golay_code_is_perfect():
    start, count, errors = nd.patterns()[0]
    assert (count == 1).all() and len(errors) == 2048
    values = np.random.default_rng(1).integers(0, 1 << 23, 1000)
    words = values ^ errors[start[nd.syndromes(values)]]
    assert (nd.syndromes(words) == 0).all() and np.bitwise_count(words ^ values).max() == 3


def test_every_link_meets_at_a_home():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 1 << 63, 3000)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            v[i] ^= np.int64(np.uint64(1) << np.uint64(b)) if b < 63 else np.int64(-(1 << 63))
    row, anchor = nd.reached(v)
    met = np.zeros(len(u), bool)
    met[row[anchor == nd.homes(u)[row]]] = True
    assert met.all()


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.choice(63, rng.integers(1, 4), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {tuple(sorted(r)) for r in nd.links(df).collect()}
    array = np.array(fps).view(np.uint64)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.bitwise_count(array[i] ^ array[j]) <= 2}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("wide", [5, graph.WIDE])
def test_components(spark, monkeypatch, wide):
    monkeypatch.setattr(graph, "WIDE", wide)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1030)] + [(2000, 2001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for copy in range(6):
            w = list(words)
            for _ in range(copy % 3):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[base * 10 + copy] = " ".join(w).upper() if copy == 5 else "\n".join(w)
    texts |= {500: None, 501: "", 502: " \t\n", 503: "one", 504: "ONE", 505: "two words", 506: "é" * 20000 + " x y"}
    df = spark.createDataFrame([(k, t, "en", "z", 1) for k, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in nd.near_duplicates(df).collect()}
    assert got == brute(texts)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d", "", "", 1), (1, "a b c d", "", "", 1), (None, "a b c d", "", "", 1), (7, "a b c d", "", "", 1)], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (7, 1), (None, None)]
    assert sorted((r["doc_id"] for r in nd.keep_one(df).collect()), key=str) == [1, None]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_rows_with_equal_ids_are_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(1, a, "", "", 1), (1, b, "", "", 2), (0, a, "", "", 3), (5, b, "", "", 4), (9, "x " * 30, "", "", 5), (9, "x " * 30, "", "", 6), (9, "y " * 30, "", "", 7)], SCHEMA)
    for found in (nd.near_duplicates, nd.near_copies):
        got = sorted((r["doc_id"], r["component_id"]) for r in found(df).collect())
        assert got == [(0, 0), (1, 0), (1, 0), (5, 0), (9, 9), (9, 9), (9, 9)]
        assert sorted((r["doc_id"], r["text"][0]) for r in nd.keep_one(df, found).collect()) == [(0, "a"), (9, "x"), (9, "y")]


def test_columns_of_any_name_are_carried(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8, 9, "q"), (2, "a b c", 1, 2, 3, "r"), (3, "d e f", 4, 5, 6, "s")], "doc_id long, text string, _id int, _n int, id int, row string")
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 7, 8, 9, "q"), (3, "d e f", 4, 5, 6, "s")]


def test_a_full_anchor_is_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, beyond = 0x2A5A5A5A5A5A & ((1 << 46) - 1), rng.choice(1 << 17, 1500, replace=False)
    fps = sorted({base | int(x) << 46 for x in beyond} | {base ^ 1 << int(rng.integers(46)) | int(x) << 46 for x in beyond[:300]})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    array = np.array(fps).view(np.uint64)
    want = {(i, int(j)) for i in range(len(fps)) for j in i + 1 + np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 2)}
    assert {tuple(sorted(r)) for r in nd.links(df).collect()} == want and len(want) > 300
    monkeypatch.setattr(nd, "MOST_RESIDENTS", 1 << 30)
    assert {tuple(sorted(r)) for r in nd.links(df).collect()} == want


def test_blocks_of_a_key_find_the_same_components(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):  # a cloud whose members are around 0.8 from each other
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(116)} for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    df = spark.createDataFrame([(k, t, "", "", 1) for k, t in texts.items()], SCHEMA)
    assert 1 < len(set(root.values())) < 90
    monkeypatch.setattr(nd, "SLICE", 7)
    for size in (500, nd.BLOCK_HASHES):
        monkeypatch.setattr(nd, "BLOCK_HASHES", size)
        assert {r["doc_id"]: r["component_id"] for r in nd.near_copies(df).collect()} == root


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = {}
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for copy in range(8):
            w = list(words)
            for _ in range(copy):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[base * 10 + copy] = " ".join(w)
    texts |= {500: None, 501: "", 502: "one", 503: "ONE", 504: texts[0] + " " + texts[0]}

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root, far = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}, 0
    prints = {k: nd.majority([nd.shingle_hashes(t)])[0] for k, t in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
                far += int(np.bitwise_count(prints[a] ^ prints[b])) > 2
    assert far > 20  # pairs that fingerprints within two bits don't link
    df = spark.createDataFrame([(k, t, "en", "z", 1) for k, t in texts.items()], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in nd.near_copies(df).collect()} == {k: find(k) for k in texts}
    kept = nd.keep_one(df, nd.near_copies)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {find(k) for k in texts}
    odd = spark.createDataFrame([(1, "a b c d", "", "", 1), (1, "a b c d", "", "", 1), (None, "a b c d", "", "", 1), (7, "a b c d", "", "", 1)], SCHEMA)
    assert sorted((r["doc_id"] for r in nd.keep_one(odd, nd.near_copies).collect()), key=str) == [1, None]
    assert nd.near_copies(odd.limit(0)).count() == 0


def test_pipeline_stage_removes_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    near = [*words[:100], "x", *words[101:250], "y", *words[251:]]  # Jaccard 0.95
    df = spark.createDataFrame([(1, " ".join(words), "en", "z", 1), (2, " ".join(near), "en", "z", 1), (3, " ".join(words[::-1]), "en", "z", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dup_stage(spark, df, "").collect()) == [1, 3]
