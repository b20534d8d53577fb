"""The near-duplicate stage goes through SimHash and its anchors; Jaccard decides."""

import random

import numpy as np

from lodestar.llm import common, near_dup


def texts():
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(6):
        base = [word() for _ in range(400)]
        out += [base, [*base, word()], [*base[:-1], word()], base[:200] + [word()] + base[201:]]
    return [*(" ".join(x) for x in out), "", "a b", None]


def prints(found):
    sets = [near_dup.shingle_set(t, 5) for t in found]
    return sets, near_dup.majority([s.astype(">u8").tobytes() for s in sets]).tolist()


def test_the_stage_checks_what_the_anchors_find(spark, monkeypatch):
    found = texts()
    sets, fps = prints(found)
    near = [(i, j) for i in range(len(found)) for j in range(i) if len(sets[i]) and len(sets[j]) and bin(fps[i] ^ fps[j]).count("1") <= near_dup.THRESHOLD]
    assert near
    seen, links, checked = [], near_dup.links, near_dup.hub_links
    monkeypatch.setattr(near_dup, "links", lambda c: seen.append({r["fp"] for r in c.collect()}) or links(c))
    pairs = set()

    def check(rows, sets, least):
        pairs.update((max(r["a"], r["b"]), min(r["a"], r["b"])) for r in rows.collect())
        return checked(rows, sets, least)

    monkeypatch.setattr(near_dup, "hub_links", check)
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_copies(docs).collect()}
    assert seen[0] == {int(x) for x in np.array(fps, np.uint64).view(np.int64)[[len(s) > 0 for s in sets]]}
    assert set(near) <= pairs
    root = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            common_ = len(np.intersect1d(sets[i], sets[j]))
            if found[i] == found[j] or (not len(sets[i]) and not len(sets[j])) or (len(sets[i]) and common_ >= 0.8 * (len(sets[i]) + len(sets[j]) - common_)):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))


def test_scored_rows_takes_batches_in_parts(spark):
    each = lambda xs: [len(xs) <= common.SLICE_ROWS and x != "7" for x in xs]
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "cast(id as string) text")
    assert common.scored_rows(docs, each).count() == 2999
