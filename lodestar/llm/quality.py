"""Line-level quality by a linear-chain conditional random field.

Every line of a document is labelled good or bad. A line's score sums its own
features and those of its neighbours; a transition score links adjacent labels.
Forward-backward gives each line's marginal probability of being good; their
mean, weighted by length, is the document's quality, mapped to a probability by
a logistic curve fitted on the training documents.

Fitting takes labelled documents, whole, in the order of their ids' hashes, as long
as they are at most SAMPLE_DOCS and have at most SAMPLE_LINES lines together (both
parameters; the first is taken in any case); a line's label in training is its document's. Scoring takes every
document, whole.

Edge cases: a null or empty text is one empty line and gets a score like any
other; documents without a label are scored alike; conflicting labels of an id
count as the smaller; without both labels in the sample all scores are 0.5;
only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_batch, arrow_schema, scored_rows, stored, utf8
from .labels import sampled

SAMPLE_DOCS, SAMPLE_LINES = 4000, 400_000
KEEP_AT = 0.7

#: Byte classes that are counted in a line; each has its share as a feature.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\v\f", "stop": b".,;:'\"()-",
    "shout": b"!?", "bar": b"|", "symbol": b"#$%&*@^~=+<>\\/_{}[]`", "beyond": bytes(range(128, 256)),
}
OWN = len(CLASSES) + 7
#: Own features, both neighbours', first line, last line.
WIDTH = 3 * OWN + 2

_CLASS_OF = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines of each text) of all lines of the texts."""
    split = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in split])
    lengths, words, distinct, repeats, seen = [], [], [], [], []
    for lines in split:
        before: set[bytes] = set()
        for line in lines:
            w = line.split()
            lengths.append(len(line))
            words.append(len(w))
            distinct.append(len(set(w)))
            repeats.append(sum(map(eq, w, w[1:])))
            seen.append(bool(w) and line in before)
            before.add(line)
    n, n_words = np.array(lengths), np.array(words)
    data = np.frombuffer(b"".join(b"".join(x) for x in split), np.uint8)
    line_of = np.repeat(np.arange(len(n)), n)
    k = len(CLASSES) + 1
    shares = np.bincount(line_of * k + _CLASS_OF[data], minlength=len(n) * k).reshape(-1, k)[:, 1:] / np.maximum(n, 1)[:, None]
    letters = np.maximum(shares[:, 0] + shares[:, 1] + shares[:, 8], 1e-9)
    own = np.column_stack([
        shares, shares[:, 0] / letters, np.log1p(n) / 10, np.minimum(n / np.maximum(n_words, 1) / 20, 1), np.array(distinct) / np.maximum(n_words, 1),
        np.array(repeats) / np.maximum(n_words - 1, 1), n_words == 0, np.array(seen),
    ]).astype(np.float64)
    ends = np.cumsum(counts)
    first, last = np.zeros(len(n), bool), np.zeros(len(n), bool)
    first[ends - counts], last[ends - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last]), np.maximum(n, 1), counts


@dataclass
class Chain:
    """weights, bias: a line's log odds of being good; links: log odds gained
    when a line's label equals the previous one's; curve: a + b * logit(mean)."""

    weights: np.ndarray
    bias: float = 0.0
    links: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line, the probability of being good; of each line but a
        document's first, of having its predecessor's label (else 0)."""
        odds = features @ self.weights + self.bias
        order = np.argsort(-counts, kind="stable")
        size, start = counts[order], (np.cumsum(counts) - counts)[order]
        good, same = np.empty(len(odds)), np.zeros(len(odds))
        ahead = np.empty(len(odds))  # log odds from the lines before and the line itself
        stay, steps = self.links, int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")

        def pass_on(x):  # log odds that a neighbour with log odds x lends through the link
            return np.logaddexp(x + stay, 0) - np.logaddexp(x, stay)

        for t in range(steps):
            at = start[: active[t]] + t
            ahead[at] = odds[at] + (pass_on(ahead[at - 1]) if t else 0)
        behind = np.zeros(len(odds))  # log odds from the lines after
        for t in range(steps - 2, -1, -1):
            at = start[: active[t + 1]] + t
            behind[at] = pass_on(odds[at + 1] + behind[at + 1])
        good = 0.5 * (1 + np.tanh((ahead + behind) / 2))
        follow = np.ones(len(odds), bool)
        follow[start] = False
        i = np.flatnonzero(follow)
        a, b = ahead[i - 1], odds[i] + behind[i]
        agree, differ = np.logaddexp(a + b, 0) + stay, np.logaddexp(a, b)
        same[i] = 0.5 * (1 + np.tanh((agree - differ) / 2))
        return good, same

    def score(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good, _ = self.marginals(features, counts)
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * logit(mean))))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> Chain:
    """Maximum conditional likelihood by Adam. Both classes of documents weigh
    alike, so that a rare one is learnt as well; the curve then puts the score
    back on the sample's own frequencies."""
    model = Chain(np.zeros(features.shape[1]))
    if len(set(labels.tolist())) < 2:
        model.curve = (0.0, 0.0)
        return model
    truth = np.repeat(labels, counts).astype(float)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())) / counts
    weight = np.repeat(share, counts)
    first = np.zeros(len(truth), bool)
    first[np.cumsum(counts) - counts] = True
    m = v = np.zeros(features.shape[1] + 2)
    for step in range(1, steps + 1):
        good, same = model.marginals(features, counts)
        error = (good - truth) * weight
        g = np.concatenate([error @ features + penalty * model.weights, [error.sum(), ((same - 1) * weight)[~first].sum() + 1e-2 * model.links]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights, model.bias, model.links = model.weights - move[:-2], model.bias - move[-2], model.links - move[-1]
    good, _ = model.marginals(features, counts)
    starts = np.cumsum(counts) - counts
    x = logit(np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts))
    a, b = 0.0, 1.0
    for _ in range(30):  # Newton's method on the two-parameter logistic
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([(labels - p).sum() - 1e-2 * a, ((labels - p) * x).sum() - 1e-2 * (b - 1)])
        hessian = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        d = np.linalg.solve(hessian, gradient)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    model.curve = (float(a), max(float(b), 0.05))
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Chain:
    """Fits on a bounded sample of the labelled documents that pass ``keep`` (a
    condition on labels); their line features, not their texts, reach the driver."""
    chosen = sampled(labels, label, sample, keep)
    ddl = "label int, counts int, lengths binary, features binary"
    schema = arrow_schema(ddl)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, n, counts = line_features([utf8(text)])
                yield arrow_batch(schema, [[y], [int(counts[0])], [n.astype(np.int64).tobytes()], [x.astype(np.float32).tobytes()]])

    # The sample is bounded, so it is broadcast and ordered by one task.
    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    counted = own.groupBy("doc_id").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).alias("n"))
    order = W.Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    fitting = stored(counted.select("doc_id", F.sum("n").over(order).alias("upto"), F.row_number().over(order).alias("place")).where((F.col("upto") <= lines) | (F.col("place") == 1)).select("doc_id"), "quality-sample")
    rows = own.join(F.broadcast(fitting), "doc_id").select("text", "label").mapInArrow(features, ddl).collect()
    if not rows:
        return fit(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    rows.sort(key=lambda r: (r["label"], r["counts"], bytes(r["features"])))
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(-1, WIDTH).astype(np.float64)
    n = np.frombuffer(b"".join(bytes(r["lengths"]) for r in rows), np.int64)
    return fit(x, n, np.array([r["counts"] for r in rows]), np.array([r["label"] for r in rows]))


def block_scores(texts: list[str | None], model: Chain) -> np.ndarray:
    """Scores of the texts, taken in blocks of bounded size, a long text alone."""
    data, out, at = [utf8(t) for t in texts], [], 0
    while at < len(data):
        end, held = at + 1, len(data[at])
        while end < len(data) and held + len(data[end]) < 1 << 19:
            held += len(data[end])
            end += 1
        out.append(model.score(*line_features(data[at:end])))
        at = end
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, score of every document."""
    schema = arrow_schema("doc_id long, score double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_batch(schema, [batch.column(0).cast(pa.int64()), block_scores(batch.column(1).to_pylist(), model)])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double")


def keep(docs: DataFrame, model: Chain, at: float = KEEP_AT) -> DataFrame:
    """``docs`` without the documents that score below ``at``: scored where they
    lie, so no row is shuffled."""
    return scored_rows(docs, lambda texts: block_scores(texts, model) >= at)
