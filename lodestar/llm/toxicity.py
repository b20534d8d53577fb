"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear model over hashed word features is fitted from confirmed toxic
documents and unlabelled text. With class prior p, the risk of calling text
toxic wrongly is estimated as (loss on unlabelled as clean) - p * (loss on
toxic as clean); where this estimate falls below zero the step goes against it,
which keeps the model from memorising the unlabelled text.

Features of a document: which words, and which word beginnings of 4, 5 and 6
bytes, occur in it, hashed to 32 bits. Those enter the model that occur in at
least LEAST toxic documents and stand out from unlabelled text by LIFT of what a
feature of toxic text alone would, whose rates differ by 1 / prior.

Fitting takes at most POSITIVES toxic and UNLABELLED unlabelled documents (by
smallest hash of their ids, so the choice doesn't depend on the partitioning), and
the ``most_features`` commonest of the features above: all three are parameters.
Features are counted and chosen in tables; the driver receives the chosen ones and,
of each document of the fit, which of them it has. Scoring takes every document,
whole.

Edge cases: null and empty texts have no features and get the score of the
bias; without toxic examples all scores are the prior, or 0; documents with
equal texts have equal scores; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, scored_rows, stored, words_of
from .labels import sampled

POSITIVES, UNLABELLED = 3000, 10_000
LEAST, LIFT, MOST_FEATURES = 5, 0.6, 1 << 16
BEGINNINGS = (4, 5, 6)
DROP_AT = 0.7
#: Distinct words whose features a worker keeps; beyond it the table starts anew.
CACHE_WORDS = 500_000
_EDGES = b".,;:!?\"'()[]{}<>|*#%&$-_/\\"


def word_features(word: bytes) -> list[int]:
    """Hashes of a word, freed of marks at its edges, and of its beginnings."""
    word = word.strip(_EDGES)
    if not word:
        return []
    found = [crc32(b"=" + word)]
    found += [crc32(b"^" + word[:n]) for n in BEGINNINGS if len(word) >= n]
    return found


@dataclass
class Model:
    index: dict[int, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], known: dict[bytes, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(score, features met) of each text. ``known``: a worker's word table."""
        get, index, rows = known.get, self.index, []
        for text in texts:
            words = set(words_of(text))
            new = [w for w in words if w not in known]
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = words
            for w in new:
                known[w] = tuple(index[f] for f in word_features(w) if f in index)
            rows.append(set(chain.from_iterable(filter(None, map(get, words)))))
        met = np.array([len(r) for r in rows])
        z = np.array([self.weights[list(r)].sum() if r else 0.0 for r in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50))), met


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.1, penalty: float = 3e-5) -> Model:
    """``positive``, ``unlabelled``: distinct feature hashes of each document."""
    if not positive:
        return Model({}, np.zeros(1), -50.0)
    if not unlabelled:
        return Model({}, np.zeros(1), float(np.log(prior / (1 - prior))))
    features, df_p = np.unique(np.concatenate(positive), return_counts=True)
    known, df_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    common = np.where(known[at] == features, df_u[at], 0) if len(known) else np.zeros(len(features))
    lift = (df_p / len(positive)) / ((common + 0.5) / len(unlabelled))
    good = np.flatnonzero((df_p >= LEAST) & (lift >= LIFT / prior))
    good = good[np.lexsort((features[good], -df_p[good]))][:MOST_FEATURES]
    index = {int(f): i for i, f in enumerate(features[good])}

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Columns of all documents, each led by the padding's, and their starts."""
        found = [[len(index), *(index[f] for f in d.tolist() if f in index)] for d in docs]
        sizes = np.array([len(r) for r in found])
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes

    (p, p_at), (u, u_at) = rows(positive), rows(unlabelled)
    p_size, u_size = np.diff(np.append(p_at, len(p))), np.diff(np.append(u_at, len(u)))
    weights, bias = np.zeros(len(index) + 1), float(np.log(prior / (1 - prior)))  # the last weight is the padding's
    m, v = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        zp, zu = np.add.reduceat(weights[p], p_at) + bias, np.add.reduceat(weights[u], u_at) + bias
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1 if clean >= 0 else -1
        # Derivatives of the risk by z; below zero only the clean part counts, reversed.
        on_u = sign * sigmoid(zu) / len(zu)
        on_p = prior * ((sigmoid(zp) - 1) * (clean >= 0) - sign * sigmoid(zp)) / len(zp)
        g = np.bincount(p, np.repeat(on_p, p_size), len(weights)) + np.bincount(u, np.repeat(on_u, u_size), len(weights))
        g = np.append(g + penalty * weights, on_p.sum() + on_u.sum())
        g[len(index)] = 0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(index, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_features: int = MOST_FEATURES) -> Model:
    """Fits on toxic documents among the labelled ones that pass ``keep`` and on
    documents taken without their labels. The prior is the share of toxic ones
    among those labelled and kept."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    n, n_toxic = chosen.agg(F.count("*"), F.sum(label)).first()
    toxic = sampled(labels.where(F.col(label) == 1), label, positives, keep).select("doc_id", F.lit(1).alias("_toxic"))
    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    wanted = toxic.join(some.withColumn("_any", F.lit(1)), "doc_id", "full").select("doc_id", F.col("_toxic").isNotNull().alias("toxic"), F.col("_any").isNotNull().alias("free"))
    ddl = "toxic boolean, free boolean, features array<long>"
    schema = arrow_schema(ddl)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(chain.from_iterable(map(word_features, set(words_of(t)))))) for t in batch.column(2).to_pylist()]
            yield arrow_batch(schema, [batch.column(0), batch.column(1), found])

    # Both samples are bounded, so they are broadcast.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted), "doc_id").select("toxic", "free", "text")
    rows = stored(rows.mapInArrow(features, ddl), "toxic-features")
    prior = min(max((n_toxic or 0) / max(n, 1), 1e-4), 0.9999)
    n_p, n_u = rows.agg(F.count_if("toxic"), F.count_if("free")).first()
    # What ``fit`` would choose, so that no other feature has to reach it.
    df = rows.select("toxic", "free", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("toxic").alias("p"), F.count_if("free").alias("u"))
    lift = (F.col("p") / max(n_p, 1)) / ((F.col("u") + 0.5) / max(n_u, 1))
    good = df.where((F.col("p") >= LEAST) & (lift >= LIFT / prior)).orderBy(F.desc("p"), "f").limit(most_features).select("f").collect()
    chosen = np.array(sorted(r["f"] for r in good), np.int64)
    slim = arrow_schema("toxic boolean, free boolean, features binary")

    def slimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(np.array(x, np.int64), chosen, assume_unique=True).astype(np.uint32).tobytes() for x in batch.column(2).to_pylist()]
            yield arrow_batch(slim, [batch.column(0), batch.column(1), own])

    kept = rows.mapInArrow(slimmed, "toxic boolean, free boolean, features binary").collect()
    kept.sort(key=lambda r: bytes(r["features"]))
    of = lambda kind: [np.frombuffer(bytes(r["features"]), np.uint32) for r in kept if r[kind]]
    return fit(of("toxic"), of("free"), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_features of every document."""
    ddl = "doc_id long, score double, n_features int"
    schema = arrow_schema(ddl)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            scores, met = model.scores(batch.column(1).to_pylist(), known)
            yield arrow_batch(schema, [batch.column(0).cast(pa.int64()), scores, met])

    return docs.select("doc_id", "text").mapInArrow(each, ddl)


def keep(docs: DataFrame, model: Model, at: float = DROP_AT) -> DataFrame:
    """``docs`` without the documents that score ``at`` or more: scored where
    they lie, so no row is shuffled."""
    known: dict[bytes, tuple[int, ...]] = {}
    return scored_rows(docs, lambda texts: model.scores(texts, known)[0] < at)
