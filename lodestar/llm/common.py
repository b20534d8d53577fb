"""What the operators of this package share: the cluster's shared folder,
tables written there, and words as the contracts define them."""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder, shared_dir, stored  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch whose texts are held as Python objects at once.
SLICE_ROWS = 1024


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def make_folder(uri: str) -> None:
    path = _local(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)


def open_write(uri: str):
    """A binary stream to a new file of the shared folder."""
    path = _local(uri)
    if path is not None:
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def as_local(uri: str, folder: str) -> str:
    """A path that can be memory-mapped: the file itself where the shared
    folder is mounted, else a copy in ``folder``, which the caller removes."""
    path = _local(uri)
    if path is not None:
        return path
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    copy = os.path.join(folder, uuid.uuid4().hex)
    with store.open_input_stream(path) as source, open(copy, "wb") as target:
        shutil.copyfileobj(source, target, 1 << 22)
    return copy


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words as bytes. On bytes both steps are ASCII only, and
    ``split`` divides at exactly the six characters that WORD excludes."""
    return utf8(text).lower().split()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ARROW = {"long": "int64", "int": "int32", "double": "float64", "float": "float32", "string": "string", "binary": "binary", "boolean": "bool_"}


def arrow_schema(ddl: str):
    """The Arrow schema of a flat DDL schema; ``array<...>`` is understood."""
    import pyarrow as pa

    def kind(name: str):
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else getattr(pa, _ARROW[name])()

    return pa.schema([(n, kind(t)) for n, t in (f.strip().split(" ", 1) for f in ddl.split(","))])


def arrow_batch(schema, columns: list):
    """A record batch of exactly this schema from lists or arrays."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000, total: int | None = None) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row a key, ``size`` its rows).

    At most ``share`` groups can hold 1/share of all rows each: these are joined
    by broadcast, so however large a group is, it stays spread over the tasks.
    All others are joined by a shuffle that no key can unbalance. ``rows`` is
    read twice and should be a stored table. ``total``: all rows, if known."""
    total = total or groups.agg(F.sum(size)).first()[0] or 0
    hot, rest = groups.where(F.col(size) * share >= total), groups.where(F.col(size) * share < total)
    spread = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return spread.unionByName(others)


def give_back() -> None:
    """Returns freed memory to the system: Python workers serve stage after stage and
    would otherwise hold the peak of each."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
    if trim:
        trim(0)


def scored_rows(docs: DataFrame, passes) -> DataFrame:
    """The rows of ``docs`` for whose texts ``passes``, a function from a list of
    texts to an array of booleans, is true; every column as it was."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                yield part.filter(pa.array(passes(part.column(at).to_pylist()), pa.bool_()))
        give_back()

    return docs.mapInArrow(each, docs.schema)
