"""Token ids in flat binary files, memory-mapped when read.

A data set is a folder of shards and a manifest. For shard s:

    ids-s       the ids of its documents, one after another, as unsigned
                little-endian integers: 16 bits where the vocabulary fits, else 32
    offsets-s   unsigned 64-bit offsets into ids-s in ids, one more than documents
    docs-s      signed 64-bit document ids, in file order

Shards follow ascending doc_id, and so do documents within them. Where a shard
begins in the whole sequence is the prefix sum over the manifest's id counts.

A task writes under names of its own and the manifest, a Parquet table that
Spark commits, names only the files of attempts that succeeded, so a lost
executor or a speculative copy can neither damage nor double a shard.

Edge cases: a null or empty text is the end id alone; documents with equal ids
are ordered by a hash of their texts, so a shard holds no more of them than of
others; a null doc_id sorts first and is stored as -2**63; an empty table gives a
manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, as_local, make_folder, new_folder, open_write

#: Distinct words whose ids a worker keeps; beyond it the table starts anew.
CACHE_WORDS = 1_200_000
MANIFEST = "shard string, number int, first_doc long, n_docs long, n_ids long, width int"
NULL_DOC = -(1 << 63)


class WordEncoder:
    """Encodes by distinct words. A tokenizer that lower-cases and drops white
    space between words gives a text's ids as the ids of its words in turn, so
    each distinct word goes through the tokenizer once for each time the table
    starts anew. A tokenizer of another kind is used on whole texts, and so is a
    text that may hold special tokens. ``by_word``: found out from the tokenizer if
    not given."""

    def __init__(self, path: str, by_word: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.known = Tokenizer.from_file(path), by_word, {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark = next((t.encode() for t in special if t.startswith("<|")), None)
        self.mark_id = special.get(self.mark.decode()) if self.mark else None
        if by_word is None:
            self.by_word = self.mark is not None and self._divides()

    def _divides(self) -> bool:
        """Whether words can be encoded apart: the normaliser lower-cases and does
        nothing else but compose letters and unify white space, the first splitter
        removes what it doesn't match, and no probe comes out otherwise."""
        spec = json.loads(self.tokenizer.to_str())
        normal, split = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        steps, parts = normal.get("normalizers", [normal]), split.get("pretokenizers", [split])
        known = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
        removes = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
        if not (known and removes and any(s.get("type") == "Lowercase" for s in steps)):
            return False
        self.by_word = True
        probes = [" a  b ", "It's THE\n\tend. Don't, 12 345.6 x", "\u00c9t\u00e9 \u0301a e\u0301 \u6f22\u5b57 \u00df!", "a.b ,c' 's ' t"]
        return self.encode(probes) == self.whole(probes)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Many words a call, divided by a special token that none of them holds."""
        for i in range(0, len(new), 20_000):
            groups = [new[j : j + 200] for j in range(i, min(i + 20_000, len(new)), 200)]
            for words, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(g).decode() for g in groups], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, self.dtype)
                cuts, data = (np.flatnonzero(ids == self.mark_id) * self.width).tolist(), ids.tobytes()
                for word, a, b in zip(words, [0, *(c + self.width for c in cuts)], [*cuts, len(data)], strict=True):
                    self.known[word] = data[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in the file's integers."""
        if not self.by_word or self.mark is None:
            return self.whole(texts)
        odd = [i for i, t in enumerate(texts) if "<|" in t]
        # A-Z only: the tokenizer lower-cases all other letters itself.
        split = [t.encode("utf-8", "replace").lower().split() for t in texts]
        for i in odd:
            split[i] = []
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = list(set(filterfalse(known.__contains__, chain.from_iterable(split))))
        if new:
            # A word and one comma or stop after it are encoded apart.
            ends = [w for w in new if w[-1:] in (b",", b".") and w[:-1].isalpha()]
            parts = {w[:-1] for w in ends} | {b",", b"."}
            self._learn([w for w in parts | set(new).difference(ends) if w not in known])
            for w in ends:
                known[w] = known[w[:-1]] + known[w[-1:]]
        get = known.__getitem__
        coded = [b"".join(map(get, words)) for words in split]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            coded[i] = ids
        return coded


_encoders: dict[tuple[str, bool | None], WordEncoder] = {}


def encoder(path: str, by_word: bool | None) -> WordEncoder:
    if (path, by_word) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, by_word] = WordEncoder(path, by_word)
    return _encoders[path, by_word]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, by_word: bool | None = None) -> str:
    """Encodes ``docs`` (doc_id, text) and returns the data set's folder."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    make_folder(folder)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, by_word)
        name, end = uuid.uuid4().hex, b"" if end_id is None else int(end_id).to_bytes(code.width, "little")
        docs_seen, lengths, ids = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, number = ids or open_write(f"{folder}/ids-{name}"), batch.column(2)[0].as_py()
            texts = batch.column(1).to_pylist()
            docs_seen += [NULL_DOC if d is None else d for d in batch.column(0).to_pylist()]
            for i in range(0, len(texts), 256):
                coded = [c + end for c in code.encode([t or "" for t in texts[i : i + 256]])]
                lengths += [len(c) // code.width for c in coded]
                ids.write(b"".join(coded))
        if ids is None:
            return
        ids.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        for kind, data in (("offsets", offsets), ("docs", np.asarray(docs_seen, "<i8"))):
            with open_write(f"{folder}/{kind}-{name}") as f:
                f.write(data.tobytes())
        yield arrow_batch(arrow_schema(MANIFEST), [[name], [number], [docs_seen[0]], [len(docs_seen)], [int(offsets[-1])], [code.width]])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered = rows.select("doc_id", "text", F.spark_partition_id().alias("number"))
    ordered.mapInArrow(shard, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The driver takes one manifest row for each shard to sum the bases."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("number").collect()
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows])])
    listed = spark.createDataFrame([(json.dumps([r["shard"], int(b), r["width"]]),) for r, b in zip(rows, bases, strict=False)], "spec string")

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spec in batch.column(0).to_pylist():
                name, base, width = json.loads(spec)
                with tempfile.TemporaryDirectory() as own:
                    ids, offsets, docs = (
                        np.memmap(as_local(f"{folder}/{kind}-{name}", own), dtype, "r") if count else np.empty(0, dtype) for kind, dtype, count in (("ids", f"<u{width}", 1), ("offsets", "<u8", 1), ("docs", "<i8", 1))
                    )
                    for i in range(0, len(docs), 4096):
                        ends = offsets[i : i + 4097].astype(np.int64)
                        block = ids[ends[0] : ends[-1]].astype("<u4").tobytes()
                        at = (ends - ends[0]) * 4
                        view = memoryview(block)
                        crc = [zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        doc = np.asarray(docs[i : i + 4096])
                        yield arrow_batch(schema, [pa.array(doc, pa.int64(), mask=doc == NULL_DOC), base + ends[:-1], np.diff(ends), crc])

    spread = listed.repartition(max(1, len(rows)))
    return spread.mapInArrow(read, ddl)
