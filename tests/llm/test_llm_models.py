"""Classifiers and the language model: against brute force, and held out."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import lm, quality, toxicity
from lodestar.llm.common import words_of
from lodestar.llm.labels import remainder

DOCS = "doc_id long, text string, label int, score double"


def good(rng):
    return "\n".join(" ".join(f"{rng.choice('abcd')}{rng.choice('efgh')}{rng.randrange(50)}" for _ in range(rng.randrange(5, 15))) + "." for _ in range(rng.randrange(1, 8)))


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, bad, toxic = good(rng), rng.random() < 0.3, rng.random() < 0.25
        if toxic:
            text = text.replace(" ", f" {rng.choice(['vileword', 'nastyone', 'vilething'])} ", 2)
        if bad:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " ### "), lambda t: ("Again " * 60 + "\n") * 3, lambda t: t.replace(" ", " | ")])(text)
        rows.append((i, text, 0, 0.0))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 3, 6])
    x = rng.normal(size=(counts.sum(), 3))
    model = quality.Chain(rng.normal(size=3), 0.3, 0.8)
    got, same = model.marginals(x, counts)
    odds, at = x @ model.weights + model.bias, 0
    for n in counts:
        o = odds[at : at + n]
        z, p, s = 0.0, np.zeros(n), np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = math.exp(sum(a * b for a, b in zip(y, o, strict=True)) + model.links * sum(a == b for a, b in zip(y, y[1:], strict=False)))
            z, p = z + w, p + w * np.array(y)
            s[1:] += w * (np.array(y[1:]) == np.array(y[:-1]))
        assert got[at : at + n] == pytest.approx(p / z) and same[at + 1 : at + n] == pytest.approx((s / z)[1:])
        at += n


def test_quality_held_out(spark):
    docs, labels, truth = corpus(spark)
    keep = remainder(F.col("doc_id"), 4) != 2
    model = quality.train(docs, labels, keep)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(scores[i], q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and sum((s >= 0.7) == q for s, q in held) >= 0.95 * len(held)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}


def test_quality_edges(spark):
    docs, labels, _ = corpus(spark, 80)
    model = quality.train(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, None, 0, 0.0), (2, "", 0, 0.0), (3, "\n" * 500, 0, 0.0), (4, "x" * 3_000_000, 0, 0.0), (5, "é", 0, 0.0), (5, "é", 0, 0.0), (None, "a", 0, 0.0)], DOCS)
    got = quality.score(odd, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    again = quality.train(docs.repartition(7), labels, F.lit(True))
    assert again.weights == pytest.approx(model.weights)


def test_toxicity_held_out(spark):
    docs, labels, truth = corpus(spark, 900, 2)
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scores[i], t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and sum((s >= 0.7) == t for s, t in held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in toxicity.keep(docs, model).collect()} == {i for i, s in scores.items() if s < 0.7}


def test_toxicity_edges(spark):
    docs, labels, _ = corpus(spark, 300, 3)
    model = toxicity.train(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, None, 0, 0.0), (2, "", 0, 0.0), (3, "z" * 1_000_000, 0, 0.0), (4, "...", 0, 0.0), (None, "a", 0, 0.0)], DOCS)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1
    none = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert all(r["score"] < 0.01 for r in toxicity.score(odd, none).collect())
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels, F.lit(True)).scores(["a"], {})[0][0] < 0.01


def test_clean_risk_is_kept_from_going_below_zero():
    rng = np.random.default_rng(1)
    positive = [np.array([1, 2, 100 + i], np.uint32) for i in range(60)]
    unlabelled = [np.array([1, 2], np.uint32) if rng.random() < 0.1 else np.array([200 + i], np.uint32) for i in range(400)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    assert set(model.index) == {1, 2} and model.weights[list(model.index.values())].sum() + model.bias > 1


def texts_for_lm(n=260, seed=1):
    rng = random.Random(seed)
    common, out = ["the", "of", "and", "Ünd", "to"], {}
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 80)):
            words += [rng.choice(common), f"n{int(rng.paretovariate(0.7)) % 3000}"] if rng.random() < 0.7 else [f"x{rng.randrange(10_000)}"]
        out[i] = "\n".join(words)
    return out | {900: None, 901: "", 902: "The THE the", 903: "never-seen \x0b words\x1c here", 904: "long " * 50_000}


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)
    texts = texts_for_lm()
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r for r in lm.report(df, remainder(F.col("doc_id"), 7) == 2).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, distinct = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(c[t] > 0 for t in ts), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (total + distinct + 1)) for t in ts))
    own = [i for i in texts if held[i] and i < 900]
    assert sum(got[i]["score"] for i in own) > sum(got[i]["base_score"] for i in own)


def small_model(rng, rows=1 << 16):
    tokens = [b"", *(b"t%d" % i for i in range(899))]
    counts = np.sort(rng.zipf(1.5, 900).clip(3, 5000))[::-1].astype(float)
    model = lm.Model(tokens, counts, int(counts.sum()) + 50, 930, 50, 30, rows)
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    return model


def test_model_probabilities_add_up_to_one():
    model = small_model(np.random.default_rng(2))
    history = [model.start, model.start, 5, 700]
    at = np.array([4])
    total = 0.0
    for token in range(len(model.tokens)):
        total += 10 ** model.log_probabilities(np.array([*history, token]), at)[0]
    rest = 10 ** model.log_probabilities(np.array([*history, model.rare]), at)[0]
    assert total + rest * (50 + 30) + rest == pytest.approx(1, abs=1e-4)  # seen rare tokens, and one unseen


def test_unigram_rates_before_training():
    model = small_model(np.random.default_rng(4))
    model.weights[:] = 0
    ids = np.array([model.start] * 3 + [0, 7, 500, model.rare])
    got = model.log_probabilities(ids, np.arange(3, 7))
    whole = model.counts.sum() + len(model.tokens) + 81
    assert got == pytest.approx([*(math.log10((model.counts[i] + 1) / whole) for i in (0, 7, 500)), math.log10(1 / whole)], abs=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    model = small_model(rng, 1 << 8)  # rows are shared by many features
    model.weights = model.weights.astype(np.float64)
    ids = np.concatenate([[model.start] * 3, rng.integers(0, 901, 40)])
    ids[ids == model.start] = model.rare
    ids[:3] = model.start
    at = np.arange(3, len(ids))
    expected, occurring = (np.zeros(model.weights.size, np.float32) for _ in range(2))
    model.add_sums(ids, at, expected, occurring)
    gradient = (expected - occurring).reshape(model.weights.shape)
    loss = lambda: -model.log_probabilities(ids, at).sum() * np.log(10)
    for k in rng.choice(np.flatnonzero(gradient), 12):
        place = np.unravel_index(k, gradient.shape)
        model.weights[place] += 0.01
        up = loss()
        model.weights[place] -= 0.02
        assert gradient[place] == pytest.approx((up - loss()) / 0.02, abs=2e-2)
        model.weights[place] += 0.01


def plain_scores(texts: dict, held: dict, head: int, rows: int) -> dict:
    """The whole model again with dicts and loops: training and scores."""
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total = sum(c.values())
    order = sorted((t for t in c if c[t] * head >= total), key=lambda t: (-c[t], t))
    number = {t: k for k, t in enumerate(order)}
    rest = sum(c[t] + 1 for t in c if t not in number) + 1
    paths, rates = lm.class_tree([*(c[t] + 1.0 for t in order), float(rest)])
    cut = (1 << 64) - 1

    def choices(ts):
        ids = [len(order) + 1] * 3 + [number.get(t, len(order)) for t in ts]
        for k in range(3, len(ids)):
            a, b, d = (ids[k - x] + 1 for x in (1, 2, 3))
            every = [a * 0x9E3779B97F4A7C15, b * 0xC2B2AE3D27D4EB4F + (1 << 40), (a * (1 << 21) + b) * 0xD6E8FEB86659FD93 + (2 << 40), d * 0xA0761D6478BD642F + (3 << 40)]
            for depth, (at, child) in enumerate(paths[ids[k]]):
                own = every if depth == 0 else every[:2]
                yield k - 3, at, child, [(((f & cut ^ at * 0xE7037ED1A0B428DB & cut) * 0x9E3779B97F4A7C15) & cut) * rows >> 64 for f in own]

    weights = {}

    def chances(at, at_rows):
        z = [math.exp(rates[at, j] + sum(weights.get((r, j), 0.0) for r in at_rows)) for j in range(lm.FAN)]
        return [x / sum(z) for x in z]

    for step in range(1 + lm.ROUNDS):
        expected, occurring = Counter(), Counter()
        for i, ts in tokens.items():
            if not held[i]:
                for _, at, child, at_rows in choices(ts):
                    p = chances(at, at_rows)
                    for r in at_rows:
                        occurring[r, child] += 1
                        for j in range(lm.FAN):
                            expected[r, j] += p[j]
        for k in expected | occurring:
            weights[k] = weights.get(k, 0.0) + (lm.RATE if step else lm.FIRST_RATE) * math.log((occurring[k] + lm.PRIOR) / (expected[k] + lm.PRIOR))
    out = {}
    for i, ts in tokens.items():
        found = sum(math.log10(chances(at, at_rows)[child]) for _, at, child, at_rows in choices(ts))
        out[i] = found + sum(math.log10((c[t] + 1) / rest) for t in ts if t not in number)
    return out


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)
    texts = {i: t for i, t in texts_for_lm(40).items() if i != 904}
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in texts.items()], DOCS)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    want = plain_scores(texts, held, 300, lm.LEAST_ROWS)
    got = {r["doc_id"]: r["score"] for r in lm.report(df, remainder(F.col("doc_id"), 7) == 2).collect()}
    assert got == {i: pytest.approx(s, rel=2e-3) for i, s in want.items()}  # sums travel as 16-bit floats


def test_the_table_grows_with_the_tokens():
    assert [lm.table_rows(n) for n in (0, 10**7, 10**8, 10**9, 10**13)] == [1 << 17, 1 << 17, 1 << 18, 1 << 21, 1 << 21]


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, "a b", 0, 0.0), (1, "a b", 0, 0.0), (None, "a", 0, 0.0)], DOCS)
    got = lm.report(df, F.lit(False)).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 8 for r in got)
    held = lm.report(df, F.lit(True)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in held)
    assert lm.report(df.limit(0), F.lit(False)).count() == 0


def test_all_training_texts_reach_every_round(spark, monkeypatch):
    seen, gather = [], lm._gather
    tokens = lambda ids: sum(int((np.frombuffer(r["ids"], np.int32)[3:] >= 0).sum()) for r in ids.collect())
    monkeypatch.setattr(lm, "_gather", lambda ids, shared, first, rows: (seen.append((first, tokens(ids))), gather(ids, shared, first, rows))[1])
    df = spark.createDataFrame([(i, f"a b c w{i % 5}") for i in range(40)], "doc_id long, text string").coalesce(1)
    lm.train(df, F.col("doc_id") < 8)
    assert seen == [(True, 32 * 8 - 3)] + [(False, 32 * 8 - 3)] * lm.ROUNDS  # four words, the end and three marks of each text


def test_the_word_three_back_is_a_feature():
    model = lm.Model([b"a", b"b", b"x", b"y"], np.array([4.0, 3.0, 2.0, 1.0]), 10, 4, 0, 0)
    rows = []
    for first in (b"x", b"y"):
        ids, marked = model.encode([[first, b"a", b"b", b"a"]])
        rows.append([int(f[3]) for f in model.features(ids, np.flatnonzero(marked))])
    assert sum(a != b for a, b in zip(*rows, strict=True)) == 1


def test_words_divided_in_arrow_are_the_words_of_the_contract(monkeypatch):
    odd = "".join(f"A{chr(c)}Z{chr(c)}" for c in range(1, 0x3100))
    texts = [None, "", " ", odd, " a  B\t", "x" * 100, "\x00 \x1c\x85 É", *["one two"] * 9]
    for size in (1, 16, 1 << 24):
        monkeypatch.setattr(lm, "SLICE", size)
        got, runs = [], list(lm.divided(pa.array(["gone", *texts], pa.string()).slice(1)))
        for _, _, words, sizes in runs:
            ends = np.cumsum(sizes)
            got += [words[e - n : e].to_pylist() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        assert got == [words_of(t) for t in texts]
        assert [r[0] for r in runs] == [0, *(r[1] for r in runs[:-1])] and runs[-1][1] == len(texts)
    assert not list(lm.divided(pa.array([], pa.string())))


def test_only_unknown_tokens_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 30)
    words = [w for k in range(100) for w in [f"w{k:02}"] * (101 - k)]  # the head needs a thirtieth: none but the end
    df = spark.createDataFrame([(i, " ".join(words[i::200])) for i in range(200)], "doc_id long, text string")
    model, counts = lm.train(df, F.lit(False))
    assert model.known.to_pylist() == [b"", *(b"w%02d" % k for k in range(29))] and len(model.counts) == 1
    assert {bytes(r["token"]): r["c"] for r in counts.collect()} == {b"w%02d" % k: 101 - k for k in range(29, 100)}
    total = len(words) + 200
    for r in lm.score(df, model, counts).collect():
        own = [101 - int(w[1:]) for w in words[r["doc_id"] :: 200]] + [200]
        assert (r["n_tokens"], r["n_known"]) == (len(own), len(own))
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (total + 102)) for c in own))


def test_equal_counts_are_known_together_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3)
    counts = lambda cs: spark.createDataFrame([(b"%d" % i, c) for i, c in enumerate(cs)], "token binary, c long")
    assert [lm.known_from(counts(cs), sum(cs)) for cs in ((9, 5, 5, 2), (9, 5, 5, 5), (5, 5, 5, 5), (2,))] == [5, 9, 1 << 62, 2]


def test_long_words_outside_the_head_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 4)
    monkeypatch.setattr(lm, "KNOWN_BYTES", 10)
    counts = spark.createDataFrame([(b"h" * 50, 40), (b"a", 5), (b"x" * 9, 4)], "token binary, c long")
    assert lm.known_from(counts, 49) == 40  # the head is known, however long
    assert lm.known_from(counts.where("c < 40"), 49) == 4
    monkeypatch.setattr(lm, "KNOWN_BYTES", 9)
    assert lm.known_from(counts.where("c < 40"), 49) == 5


def test_a_long_text_settles_like_many_short_ones(spark, monkeypatch):
    monkeypatch.setattr(lm, "SETTLE", 64)
    sizes, add = [], lm.Model.add_sums
    monkeypatch.setattr(lm.Model, "add_sums", lambda self, ids, at, *sums: (sizes.append(len(at)), add(self, ids, at, *sums))[1])
    taken = {}

    class Batches:  # runs the tasks' function here
        def mapInArrow(self, f, ddl):
            taken["f"] = f
            raise LookupError

    model = lm.Model([b"", b"a", b"b"], np.array([300.0, 200.0, 100.0]), 600, 3, 0, 0, 1 << 8)
    monkeypatch.setattr(lm, "_model", lambda shared: model)
    with pytest.raises(LookupError):
        lm._gather(Batches(), None, True, model.rows)
    ids = model.encode([[b"a", b"b"] * 500])[0].astype(np.int32)
    out = list(taken["f"](iter([pa.record_batch([pa.array([ids.tobytes()])], ["ids"])])))
    assert sum(sizes) == 1001 and max(sizes) <= 2 * lm.SETTLE
    flat = np.concatenate([lm._long(d) for d in out[0].column(1).to_pylist()])
    features = 2 * sum(model.depth[ids[3:]]) + 2 * 1001  # four rows at the root, two below
    assert [x.sum() for x in np.split(flat, 2)] == pytest.approx([features] * 2, rel=1e-2)
