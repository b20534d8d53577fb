"""Language-model scores: a hashed maximum-entropy model with a class-factored
softmax, beside an add-one unigram base.

Counts. Every token of every training text is counted; the sums are N, V and
each token's c. All later stages use these counts.

Classes. Tokens that make up at least 1/HEAD of all training tokens, so at most
HEAD of them, are the head; all the rest, unseen ones included, are one leaf. The
leaves form a tree of classes within classes, FAN children to a class (Huffman's,
by token mass, so a frequent token lies under few classes). P(token | history) is
the product of softmax choices on the way from the root to the leaf, each of which
depends on the history; inside the rest it goes on with (c + 1) over the rest's
sum. So the model's probabilities add up to 1.

Features of a history: the word before (n-gram), the one before that (skip);
for the choice at the root also both together (n-gram) and the one three back
(skip). A feature's weights at a class are a row of the table, found by hash. The
table grows with the training tokens: the least power of two of rows that leaves
at most ROW_TOKENS a row, between LEAST_ROWS and MOST_ROWS; the last bounds what
is broadcast, at 64 MB. The counts grow without a bound, and are joined.

Training. Each of 1 + ROUNDS rounds is one distributed gradient update over all
training texts: every task sums, for every row and child, how often the model
expects it at the current weights, and in the first round how often it occurs. The
gradient is the difference of the two; a weight moves by RATE (FIRST_RATE in the
first round, which starts from unigram rates) times the log ratio of the two, the
step of iterative scaling, which has the gradient's sign and is bounded. Rounds
read the head ids of the texts, stored once, and not the texts. The tasks' sums travel as 16-bit floats and are added up by block of the table.

Scoring. Texts are scored in numpy batches. The head and the most frequent tokens after
it, HEAD in all and KNOWN_BYTES long at most, are known to every task with their counts;
all others go, once a text, through a join with the counts. A token there makes up less
than 1/HEAD of the training tokens, so no key of that join is hot.

Words are divided, counted and looked up in Arrow arrays, never as Python objects.

Edge cases: null and empty texts are the end token alone; without training
texts every token is unseen, and base and score are equal; rows that repeat an
id give a row each; a null id counts as held out by no rule and trains; only
doc_id and text are read.
"""

from __future__ import annotations

import copy
import heapq
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, give_back, stored

HEAD, KNOWN_BYTES, FAN = 1_000_000, 1 << 25, 8
ROW_TOKENS, LEAST_ROWS, MOST_ROWS = 1 << 9, 1 << 17, 1 << 21
ROUNDS, PRIOR, FIRST_RATE, RATE, MOST_WEIGHT = 3, 5.0, 0.5, 0.35, 12.0
#: Bytes of text that are divided into words at once; tokens in a numpy batch; tokens
#: whose sums are held in 32 bits before they join the 64-bit ones.
SLICE, BATCH, SETTLE = 1 << 24, 1 << 15, 1 << 19
END = b""


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of whole items of these sizes, each of about ``most``
    together; an item that is larger ends a run."""
    if len(sizes):
        starts = np.cumsum(sizes) - sizes
        cuts = np.flatnonzero(np.diff(starts // most)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def divided(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Runs of whole texts: first, end, their words one after another as ``words_of``
    gives them, and how many each text has. Arrow's functions for ASCII take A-Z and
    exactly the six characters that WORD excludes; they leave blanks at a text's ends."""
    for first, end in runs_of(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), SLICE):
        part = texts.slice(first, end - first).cast(pa.string()).fill_null("")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        filled = pc.binary_length(words).to_numpy() > 0
        if not filled.all():
            words, offsets = words.filter(pa.array(filled)), np.append(0, np.cumsum(filled))[offsets]
        yield first, end, words.view(pa.binary()), np.diff(offsets).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all of ``docs``."""
    schema = arrow_schema("token binary, c long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words, _ in divided(batch.column(0)):
                found = words.value_counts()
                ends = pa.array([END], pa.binary()), pa.array([end - first], pa.int64())
                yield arrow_batch(schema, [pa.concat_arrays(pair) for pair in zip(found.flatten(), ends, strict=True)])
        give_back()

    return docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def rows_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table of FAN columns, copied 16 bytes at a time: numpy copies few long
    items faster than many short ones."""
    return table.view(np.complex128).take(at, axis=0, mode="clip").view(table.dtype)


def class_tree(weights: list[float]) -> tuple[list[tuple], np.ndarray]:
    """Huffman's tree of FAN children a class over leaves of these weights: each
    leaf's path as (class, child) from the root, class 0, down; and each class's log
    rates of its children, absent ones at -1e4."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)] + [(0.0, -1 - i) for i in range((1 - n) % (FAN - 1))]
    heapq.heapify(heap)
    classes = []
    while len(heap) > 1:
        children = [heapq.heappop(heap) for _ in range(FAN)]
        heapq.heappush(heap, (sum(w for w, _ in children), n + len(classes)))
        classes.append(children)
    rates, paths = np.full((len(classes), FAN), -1e4, np.float32), [()] * n
    below = [()] * len(classes)
    for at in range(len(classes)):  # the root was made last
        children = classes[-1 - at]
        total = sum(w for w, _ in children)
        for child, (w, i) in enumerate(children):
            path = (*below[at], (at, child))
            if i >= 0:
                rates[at, child] = np.log(w / total)
                if i < n:
                    paths[i] = path
                else:
                    below[len(classes) - 1 - (i - n)] = path
    return paths, rates


@dataclass
class Model:
    """tokens: the head by falling count. more: the other known tokens, by falling
    count too. weights: a row of FAN for each hashed (feature, class)."""

    tokens: list[bytes] | pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    rest_total: int
    rest_distinct: int
    rows: int = LEAST_ROWS
    more: list[bytes] | pa.Array = ()
    more_counts: np.ndarray = ()
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.tokens)
        self.rare, self.start = n, n + 1
        self.known = pa.concat_arrays([pa.array(t, pa.binary()) for t in (self.tokens, self.more)])
        self.log_count = np.append(np.log10(np.append(self.counts, self.more_counts) + 1.0), 0.0)
        self.log_rest = float(np.log10(self.rest_total + self.rest_distinct + 1))
        paths, self.rates = class_tree([*(self.counts + 1.0), self.rest_total + self.rest_distinct + 1.0])
        self.depth = np.array([len(p) for p in paths])
        # (class, child) of each leaf by depth.
        self.classes, self.children = (np.zeros((self.depth.max(), n + 1), np.int32) for _ in range(2))
        for leaf, path in enumerate(paths):
            for d, (at, child) in enumerate(path):
                self.classes[d, leaf], self.children[d, leaf] = at, child
        self.weights = np.zeros((self.rows, FAN), np.float32)

    def places(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Places among the known tokens of the words and end tokens of texts with
        so many words, -1 for others; -2 for the three start marks that lead each text."""
        found = pc.index_in(pa.concat_arrays([words, pa.array([END], pa.binary())]), value_set=self.known).fill_null(-1).to_numpy()
        ends = np.cumsum(sizes + 4)
        out = np.full(int(sizes.sum()) + 4 * len(sizes), -2, np.int32)
        out[np.arange(len(words)) + np.repeat(4 * np.arange(len(sizes)) + 3, sizes)] = found[:-1]
        out[ends - 1] = found[-1]
        return out

    def head_ids(self, places: np.ndarray) -> np.ndarray:
        """Head ids of tokens at these places; a start mark has one of its own."""
        return np.where(places == -2, self.start, np.where((places < 0) | (places >= self.rare), self.rare, places))

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Head ids of the texts' words and end tokens, each text led by three
        start marks; which of them are tokens."""
        words = pa.array([w for words in texts for w in words], pa.binary())
        ids = self.head_ids(self.places(words, np.array([len(w) for w in texts], np.int64)))
        return ids, ids != self.start

    def features(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Numbers of each history's features, the two of every class first."""
        a, b, c = (ids[at - k].astype(np.uint64) + np.uint64(1) for k in (1, 2, 3))
        both = a * np.uint64(1 << 21) + b
        salted = ((a, 0x9E3779B97F4A7C15, 0), (b, 0xC2B2AE3D27D4EB4F, 1), (both, 0xD6E8FEB86659FD93, 2), (c, 0xA0761D6478BD642F, 3))
        return [key * np.uint64(factor) + np.uint64(salt << 40) for key, factor, salt in salted]

    def choices(self, ids: np.ndarray, at: np.ndarray, flat: bool = False) -> Iterator[tuple]:
        """The choices that the tokens at ``at`` are made of, a depth at a time:
        (which tokens, chosen child, rows of the table, scores, their exponentials and
        these's sums). ``flat``: all weights are 0. Weights are bounded, so the
        exponentials are as well. Sums go without the linear algebra library, whose
        threads would crowd a worker's core."""
        # The deepest leaves first, so that those left at a depth are a slice.
        depth = self.depth[ids[at]]
        own = np.argsort((255 - depth).astype(np.uint8), kind="stable")
        left = len(at) - np.cumsum(np.bincount(depth, minlength=len(self.classes) + 1))
        at = at[own]
        token, features = ids[at], self.features(ids, at)
        shift = np.uint64(65 - self.rows.bit_length())
        for d, n in enumerate(left[:-1]):
            if not n:
                return
            token, own, features = token[:n], own[:n], [f[:n] for f in features]
            classes = self.classes[d][token]
            salt = classes.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
            rows = [(((f ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> shift).view(np.int64) for f in features]
            scores = rows_of(self.rates, classes)
            for r in () if flat else rows:
                scores += rows_of(self.weights, r)
            powers = np.exp(scores)
            yield own, self.children[d][token], rows, scores, powers, np.einsum("ij->i", powers)
            features = features[:2]

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; for a token of the rest without its
        own log10(c + 1), which the join adds."""
        out = np.zeros(len(at))
        for own, child, _, scores, _, sums in self.choices(ids, at):
            out[own] += scores[np.arange(len(own)), child] - np.log(sums)
        return out / np.log(10) - np.where(ids[at] == self.rare, self.log_rest, 0.0)

    def add_sums(self, ids: np.ndarray, at: np.ndarray, expected: np.ndarray, occurring: np.ndarray | None) -> None:
        """Adds how often each child is expected at each row and, if asked, occurs. The sums
        are held in 32 bits meanwhile, so ``at`` should be about SETTLE long; two children make
        a complex number, and each such pair has an array that the rows index as they are."""
        wide = FAN // 2
        held, flat = np.zeros((wide, self.rows), np.complex64), not self.weights.any()
        seen = None if occurring is None else np.zeros(occurring.size, np.float32)
        for piece in _pieces(at):
            for _, child, rows, _, powers, sums in self.choices(ids, piece, flat):
                added = np.ascontiguousarray(powers.view(np.complex64).T)
                added *= (1 / sums).astype(np.complex64)
                for r in rows:
                    for pairs, some in zip(held, added, strict=True):
                        np.add.at(pairs, r, some)
                    if seen is not None:
                        np.add.at(seen, r * FAN + child, np.float32(1))
        whole = expected.view(np.result_type(expected, np.complex64)).reshape(-1, wide)
        for k, pairs in enumerate(held):
            whole[:, k] += pairs
        if seen is not None:
            occurring += seen

    def step(self, occurring: np.ndarray, expected: np.ndarray, rate: float) -> None:
        move = rate * np.log((occurring + PRIOR) / (expected + PRIOR))
        self.weights = np.clip(self.weights + move.reshape(self.weights.shape), -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def _pieces(at: np.ndarray, size: int = BATCH) -> Iterator[np.ndarray]:
    """Places of tokens in even pieces of about ``size``."""
    yield from np.array_split(at, max(1, round(len(at) / size)))


_models: dict[str, Model] = {}


def _model(shared) -> Model:
    """A worker unpacks a model once; the last two are kept."""
    if shared.id not in _models:
        while len(_models) > 1:
            _models.pop(next(iter(_models)))
        _models[shared.id] = pickle.loads(zlib.decompress(shared.value[1]))
    return _models[shared.id]


class _Shared:
    """A broadcast model with the first ``words`` of its known tokens. Its size is
    bounded by HEAD, the head's words, KNOWN_BYTES and MOST_ROWS."""

    def __init__(self, spark, model: Model, words: int):
        sent = copy.copy(model)
        sent.known, sent.log_count = model.known.take(pa.array(range(words), pa.int64())), np.append(model.log_count[:words], 0.0)
        sent.tokens = sent.counts = sent.more = sent.more_counts = ()  # these again
        self.id = uuid.uuid4().hex
        self.held = spark.sparkContext.broadcast((self.id, zlib.compress(pickle.dumps(sent), 1)))

    @property
    def value(self):
        return self.held.value


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """A stored table of the texts' head ids, as ``encode`` gives them, in blocks
    of whole texts: every round reads these instead of the texts."""
    shared, schema = _Shared(docs.sparkSession, model, model.rare), arrow_schema("ids binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared)
        for batch in batches:
            for _, _, words, sizes in divided(batch.column(0)):
                ids, ends = m.head_ids(m.places(words, sizes)).astype(np.int32), np.cumsum(sizes + 4)
                for first, end in runs_of(sizes + 4, BATCH):
                    yield arrow_batch(schema, [[ids[ends[first] - sizes[first] - 4 : ends[end - 1]].tobytes()]])
        give_back()

    return stored(docs.select("text").mapInArrow(each, "ids binary"), "token-ids", "zstd")


PARTS = 32


def _short(x: np.ndarray) -> bytes:
    """Floats rounded to their upper 16 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return ((bits + 0x8000) >> 16).astype(np.uint16).tobytes()


def _long(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, np.uint16).astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def _gather(ids: DataFrame, shared: _Shared, first: bool, rows: int) -> list[np.ndarray]:
    """The tasks' sums over the ``encoded`` texts added up: expected and, in the
    first round, occurring."""
    ddl = "part int, data binary"
    schema = arrow_schema(ddl)
    kinds, size = 1 + first, rows * FAN

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        totals, held, n = [np.zeros(size) for _ in range(kinds)], [], 0

        def settle() -> None:
            own = np.concatenate(held)
            for at in _pieces(np.flatnonzero(own != model.start), SETTLE):
                model.add_sums(own, at, totals[0], totals[1] if first else None)
            held.clear()

        for data in (x for b in batches for x in b.column(0)):
            held.append(np.frombuffer(data.as_buffer(), np.int32))
            n += len(held[-1])
            if n > SETTLE:
                settle()
                n = 0
        if held:
            settle()
        cut = np.array_split(np.concatenate(totals), PARTS)
        yield arrow_batch(schema, [list(range(PARTS)), [_short(c) for c in cut]])
        give_back()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _long(data)
                held[k] = held[k] + x if k in held else x
        if held:
            yield arrow_batch(schema, [list(held), [v.astype(np.float32).tobytes() for v in held.values()]])

    found = ids.mapInArrow(sums, ddl).repartition(PARTS, "part").mapInArrow(added, ddl).collect()
    flat = np.concatenate([np.frombuffer(bytes(r["data"]), np.float32) for r in sorted(found, key=lambda r: r["part"])]) if found else np.zeros(kinds * size)
    return np.split(flat, kinds)


def table_rows(tokens: int) -> int:
    """Rows of the weight table for so many training tokens."""
    wanted = -(-tokens // ROW_TOKENS)
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, wanted - 1).bit_length()))


def known_from(counts: DataFrame, total: int) -> int:
    """The least c of a known token: no more than HEAD tokens have it or a larger one, and
    together these are no longer than KNOWN_BYTES or all of the head."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("long")).toArrow().sort_by([("c", "descending")])
    c, n, long = (sizes[k].to_numpy() for k in ("c", "n", "long"))
    among = c[(np.cumsum(n) <= HEAD) & ((np.cumsum(long) <= KNOWN_BYTES) | (c * HEAD >= total))]
    return int(among[-1]) if len(among) else 1 << 62


def train(docs: DataFrame, held_out: Column) -> tuple[Model, DataFrame]:
    """The model, and the counts of the tokens that it doesn't know (token, c)."""
    spark = docs.sparkSession
    own = docs.where(~F.coalesce(held_out, F.lit(False)))
    counts = stored(count_tokens(own), "token-counts")
    distinct, total = counts.agg(F.count("*"), F.sum("c")).first()
    total = total or 0
    least = known_from(counts, total)
    known = counts.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    tokens, c = known["token"].combine_chunks().cast(pa.binary()), known["c"].to_numpy().astype(np.float64)
    n = int(np.count_nonzero(c * HEAD >= total))  # at most HEAD tokens can hold 1/HEAD of all each
    model = Model(tokens[:n], c[:n], total, distinct, int(total - c[:n].sum()), distinct - n, table_rows(total), tokens[n:], c[n:])
    ids = encoded(own, model)
    expected, occurring = _gather(ids, _Shared(spark, model, words=0), True, model.rows)
    model.step(occurring, expected, FIRST_RATE)
    for _ in range(ROUNDS):
        model.step(occurring, *_gather(ids, _Shared(spark, model, words=0), False, model.rows), RATE)
    return model, counts.where(F.col("c") < least)


ROW = "token binary, row long, n int, doc_id long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""
    shared, schema = _Shared(docs.sparkSession, model, len(model.known)), arrow_schema(ROW)
    log_all = float(np.log10(model.total + model.distinct + 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared)
        for batch in batches:
            for first, end, words, sizes in divided(batch.column(2)):
                rows, doc_ids = (batch.column(k).slice(first, end - first).cast(pa.int64()) for k in (0, 1))
                places = m.places(words, sizes)
                ids, marked = m.head_ids(places), places != -2
                logs = np.concatenate([m.log_probabilities(ids, at) for at in _pieces(np.flatnonzero(marked))])
                places, sizes = places[marked], sizes + 1
                starts = np.cumsum(sizes) - sizes
                own = m.log_count[places]  # 0 for the unknown
                logs += np.where(places >= m.rare, own, 0.0)
                known = np.add.reduceat((places >= 0).astype(np.int64), starts)
                base = np.add.reduceat(own, starts) - sizes * log_all
                # One row for each text, under a key that no token has; then its unknown tokens.
                keys = [b" %d" % r for r in rows.to_pylist()]
                yield arrow_batch(schema, [keys, rows, [0] * len(keys), doc_ids, sizes, known, base, np.add.reduceat(logs, starts)])
                other, last = places < 0, starts + sizes - 1
                ends = rows.filter(pa.array(other[last]))
                other, at = np.delete(other, last), np.repeat(rows.to_numpy(), sizes - 1)
                table = pa.table({"token": pa.concat_arrays([words.filter(pa.array(other)), pa.array([END] * len(ends), pa.binary())]), "row": pa.concat_arrays([pa.array(at[other]), ends])})
                found = table.group_by(["token", "row"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                for part in found.select(["token", "row", "count_all"]).to_batches():
                    yield arrow_batch(schema, [part.column(0), part.column(1), part.column(2).cast(pa.int32()), *[pa.nulls(part.num_rows, f.type) for f in list(schema)[3:]]])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(each, ROW)
    met = rows.join(counts, "token", "left")
    logs = F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1))
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"), (F.max("base") + logs).alias("base_score"), (F.max("score") + logs).alias("score"))
    return out.drop("row")


def report(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = train(docs, held_out)
    return score(docs, model, counts).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
