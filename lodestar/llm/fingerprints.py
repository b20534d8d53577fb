"""Document fingerprints: weighted SimHash, and search by permuted block tables.

Terms are pairs of adjacent words. Each term's 128-bit XXH3 value votes for or
against every bit with the term's weight, its length in bytes, 255 at most: long
terms are rare ones, and a term that is repeated votes each time (Charikar, 2002).

Search within RADIUS = 3 bits (after Manku, Jain and Das Sarma, 2007): the 128
bits are cut into five blocks; three flipped bits leave at least two blocks
untouched, so a pair agrees on the leading blocks of one of the ten tables that
put two blocks first. Each table's key has 50 bits or more.

Edge cases: null and empty texts, and texts of white space, have fingerprint
zero; a text of one word has that word as its term; documents with equal ids
follow one another by a hash of their texts, so a range holds no more of them than
of others; null ids sort first; a table of one document is its own next one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_batch, arrow_schema, stored, utf8, words_of

BITS, RADIUS = 128, 3
#: Bytes of term hashes that are voted on at once.
BLOCK_BYTES = 1 << 20


def _terms(text: str | None) -> tuple[bytes, bytes]:
    words = words_of(text)
    terms = [b" ".join(p) for p in zip(words, words[1:], strict=False)] or words
    return b"".join(map(xxhash.xxh3_128_digest, terms)), bytes([min(len(t), 255) for t in terms])


def _vote(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(parts), BITS // 8), np.uint8)
    counts = np.array([len(w) for _, w in parts], np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        weights = np.frombuffer(b"".join(w for _, w in parts), np.uint8)
        bits = np.unpackbits(np.frombuffer(b"".join(h for h, _ in parts), np.uint8)).reshape(-1, BITS)
        bits *= weights[:, None]
        starts = np.cumsum(counts[some]) - counts[some]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        total = np.add.reduceat(weights, starts, dtype=np.int64)
        out[some] = np.packbits(2 * votes > total[:, None], axis=1)
    return out


def simhash(texts: list[str | None]) -> np.ndarray:
    """Fingerprints as rows of 16 bytes."""
    done, part, held = [], [], 0
    for text in texts:
        part.append(_terms(text))
        held += len(part[-1][0])
        if held > BLOCK_BYTES:
            done.append(_vote(part))
            part, held = [], 0
    return np.concatenate([*done, _vote(part)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / BITS


def edited(text: str | None, following: str | None) -> str:
    """``text`` with its last quarter replaced by as much of the next one."""
    text, k = text or "", len(text or "") // 4
    return text[: len(text) - k] + (following or "")[:k]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, hi long, lo long, edited_fingerprint string, near_edited double, near_next double"
SEAM = ", shard int, head string, tail string"


def _rows(ids: list, texts: list, following: list) -> list:
    """The columns of FIELDS for texts whose next documents are given."""
    own = simhash([*texts, following[-1]])
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    other = simhash(changed)
    words = own[:-1].view(">i8").astype(np.int64)
    hexed = other.tobytes().hex()
    return [
        ids, [len(t or "") for t in texts], [hashlib.sha256(utf8(t)).hexdigest() for t in changed], words[:, 0], words[:, 1],
        [hexed[i : i + 32] for i in range(0, len(hexed), 32)], likeness(own[:-1], other), likeness(own[:-1], own[1:]),
    ]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """FIELDS of every document. Documents are dealt by range of doc_id; where
    one range meets the next, the last document's row waits for the first of
    the next range, which a join of one row a range brings."""
    full, names = arrow_schema(FIELDS + SEAM), arrow_schema(FIELDS).names

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts, numbers = (c.to_pylist() for c in batch.slice(at, 256).columns)
                if shard is None:
                    shard = numbers[0]
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "head": texts[0] or ""}], full)
                if held:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids.pop(), texts[-1]
                if ids:
                    columns = _rows(ids, texts[:-1], texts[1:])
                    yield arrow_batch(full, [*columns, *[pa.nulls(len(ids), f.type) for f in list(full)[len(columns) :]]])
        if held:
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "shard": shard, "tail": held[1] or ""}], full)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    swept = stored(ordered.mapInArrow(sweep, FIELDS + SEAM), "fingerprints")
    heads = swept.where("head is not null").select("shard", "head")
    # One row a range; without the texts, so that one task can order them.
    order = heads.select("shard", F.lead("shard").over(W.Window.orderBy("shard")).alias("after"), F.first("shard").over(W.Window.orderBy("shard")).alias("first"), F.row_number().over(W.Window.orderBy(F.desc("shard"))).alias("from_end"))
    order = order.select("shard", F.when(F.col("from_end") == 1, F.col("first")).otherwise(F.col("after")).alias("after"))
    tails = swept.where("tail is not null").select("doc_id", "shard", "tail")
    pairs = tails.join(order, "shard").select("doc_id", "tail", "after")
    pairs = pairs.join(heads, F.col("after") == F.col("shard")).select("doc_id", "tail", "head")
    short = arrow_schema(FIELDS)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield arrow_batch(short, _rows([row["doc_id"]], [row["tail"]], [row["head"]]))

    return swept.where("head is null and tail is null").select(*names).unionByName(pairs.mapInArrow(close, FIELDS))


def _block(i: int, hi: str, lo: str) -> Column:
    return F.expr((f"shiftrightunsigned({hi}, 38)", f"shiftrightunsigned({hi}, 12) & 67108863", f"(({hi} & 4095) << 13) | shiftrightunsigned({lo}, 51)", f"shiftrightunsigned({lo}, 26) & 33554431", f"{lo} & 67108863")[i])


def _tables(fps: DataFrame) -> DataFrame:
    """Each fingerprint in the ten tables that put two of the five blocks first."""
    keys = [F.struct(F.lit(t).alias("table"), F.shiftleft(_block(i, "hi", "lo"), 26).bitwiseOR(_block(j, "hi", "lo")).alias("key")) for t, (i, j) in enumerate(combinations(range(5), 2))]
    return fps.withColumn("t", F.explode(F.array(*keys))).select("*", "t.table", "t.key").drop("t")


def count_near(fps: DataFrame, asked: DataFrame) -> DataFrame:
    """hi, lo, n_near: for each distinct fingerprint of ``asked``, how many rows
    of ``fps`` (hi, lo) lie within RADIUS, rows with the fingerprint included."""
    all_fps = fps.groupBy("hi", "lo").agg(F.count("*").alias("rows"))
    found = _tables(asked.select("hi", "lo").distinct()).alias("q").join(_tables(all_fps).alias("f"), F.expr(f"q.table = f.table and q.key = f.key and bit_count(q.hi ^ f.hi) + bit_count(q.lo ^ f.lo) <= {RADIUS}"))
    once = found.select(F.col("q.hi").alias("hi"), F.col("q.lo").alias("lo"), F.col("f.hi").alias("fhi"), F.col("f.lo").alias("flo"), "rows").distinct()
    return once.groupBy("hi", "lo").agg(F.sum("rows").alias("n_near"))


def report(docs: DataFrame) -> DataFrame:
    """FIELDS with the fingerprint as 32 hexadecimal digits, and n_near: for ids
    divisible by 100, how many other documents lie within RADIUS (else null)."""
    rows = stored(fingerprint_edits(docs), "edits")
    asked = rows.where("doc_id % 100 = 0")
    near = count_near(rows, asked)
    counted = asked.select("doc_id", "hi", "lo").distinct().join(near, ["hi", "lo"]).select(F.col("doc_id").alias("q"), (F.col("n_near") - 1).alias("n_near"))
    text = F.concat(F.lpad(F.lower(F.hex("hi")), 16, "0"), F.lpad(F.lower(F.hex("lo")), 16, "0")).alias("fingerprint")
    every = rows.select("doc_id", "n_chars", "edited_sha256", text, "edited_fingerprint", "near_edited", "near_next")
    return every.join(counted.dropDuplicates(["q"]), F.col("doc_id") == F.col("q"), "left").drop("q")
