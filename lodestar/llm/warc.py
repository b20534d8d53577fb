"""WARC archives: a writer with revisit records, and a salvage reader.

Files hold one gzip member for each record (WARC/1.1); plain files are read as
well. The reader checks each record: the member's own checksum, the version
line, header fields, content length, closing line ends, and the block and
payload digests. After a failed check it searches for the next gzip member or
version line that begins a valid record, goes on from there, and logs the bytes
between as a quarantined gap. A member may hold several records; of a damaged one
among them the others are recovered alike. Searches go on from where the last one
found something, so a file is searched once however many false starts it has.

Tasks write files under names of their own; the manifest, a Parquet table that
Spark commits, lists those of successful attempts only.

Edge cases: null and empty html is an empty payload; payloads under the size
limit are always responses; rows that repeat the largest page_id of a payload
are responses each; a null page_id is kept as null and never referred to; an
empty table gives no records; a member that unpacks to more than MOST_BYTES (2 GiB,
beyond what a text can be) is a logged gap, and ``round_trip`` fails on any gap;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import mmap
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, as_local, join_groups, make_folder, new_folder, open_write, stored, utf8

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are stored once.
LEAST_BYTES = 1000
#: A gzip member that unpacks to more than this is taken for damaged.
MOST_BYTES = 1 << 31


class Broken(ValueError):
    """A failed check."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: its response, or a revisit of another's."""
    name = "none" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "about:blank")), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, wbits=31)
    return pack.compress(data) + pack.flush()


@dataclass
class Record:
    offset: int
    end: int
    fields: dict[str, str]
    block: bytes
    payload: bytes | None = None
    http: dict[str, str] = field(default_factory=dict)


def _fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise Broken("header line")
        found[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "surrogatepass")
    return found


class Finder:
    """Places of byte strings in ``data``, asked for at rising positions: what was
    found last stands until it is passed."""

    def __init__(self, data):
        self.data, self.found = data, {}

    def next(self, wanted: bytes, at: int, use: int = 0) -> int:
        """The first place at or after ``at``; the end of the data if there is none.
        Different uses of a byte string are remembered apart."""
        asked, place = self.found.get((wanted, use), (0, -1))
        if place < at or at < asked:
            place = self.data.find(wanted, at)
            place = len(self.data) if place < 0 else place
            self.found[wanted, use] = at, place
        return place


def parse_record(data, at: int, finder: Finder | None = None) -> tuple[int, Record]:
    """(end, record) of the plain record at ``at``, all checks passed."""
    if not re.fullmatch(rb"WARC/1\.\d+\r\n", bytes(data[at : at + 10])):
        raise Broken("version line")
    end_head = (finder or Finder(data)).next(b"\r\n\r\n", at)
    if end_head == len(data):
        raise Broken("header")
    fields = _fields(bytes(data[at + 10 : end_head]))
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Broken("content length")
    start, end = end_head + 4, end_head + 4 + int(length)
    block = bytes(data[start:end])
    if len(block) < int(length) or data[end : end + 4] != b"\r\n\r\n":
        raise Broken("record end")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise Broken("block digest")
    found = Record(at, end + 4, fields, block)
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, body = block.partition(b"\r\n\r\n")
        if not blank:
            raise Broken("http header")
        found.http = _fields(head.partition(b"\r\n")[2])
        if fields.get("warc-type") == "response":
            found.payload = body
    elif fields.get("warc-type") != "revisit":
        found.payload = block
    if found.payload is not None and "warc-payload-digest" in fields and fields["warc-payload-digest"] != _digest(found.payload):
        raise Broken("payload digest")
    return end + 4, found


def _unpack(data, at: int, finder: Finder) -> tuple[int, bytes]:
    """(end, content) of the gzip member at ``at`` (RFC 1952). Its header is read by
    ``finder``, so that names without an end don't cost a search each."""
    head, size = bytes(data[at : at + 12]), len(data)
    if len(head) < 12 or head[3] & 0xE0:
        raise Broken("member header")
    i = at + 10
    if head[3] & 4:
        i += 2 + int.from_bytes(head[10:12], "little")
    for flag in (8, 16):  # name, comment
        if head[3] & flag:
            i = finder.next(b"\0", i, flag) + 1
    i += head[3] & 2
    pack, parts, unpacked, crc, step = zlib.decompressobj(wbits=-15), [], 0, 0, 1 << 12
    try:
        while not pack.eof:
            piece = bytes(data[i : i + step])
            if not piece:
                raise Broken("member cut off")
            i, step = i + len(piece), 1 << 16
            parts.append(pack.decompress(piece))
            unpacked, crc = unpacked + len(parts[-1]), zlib.crc32(parts[-1], crc)
            if unpacked > MOST_BYTES:
                raise Broken("member too large")
    except zlib.error as e:
        raise Broken(f"member: {e}") from e
    i -= len(pack.unused_data)
    if i + 8 > size:
        raise Broken("member cut off")
    if bytes(data[i : i + 8]) != crc.to_bytes(4, "little") + (unpacked & 0xFFFFFFFF).to_bytes(4, "little"):
        raise Broken("member checksum")
    return i + 8, b"".join(parts)


def _members(content: bytes, at: int, end: int) -> Iterator[Record | tuple[int, int, str]]:
    """The records of a member's content, which lies from ``at`` to ``end``."""
    found = list(salvage(content))
    if not any(isinstance(x, Record) for x in found):
        raise Broken(found[0][2] if found else "empty member")
    for x in found:
        if isinstance(x, tuple):
            yield at, end, f"in member: {x[2]}"
        else:
            x.offset, x.end = at, end
            yield x


def salvage(data) -> Iterator[Record | tuple[int, int, str]]:
    """Valid records in file order, and (start, end, reason) of the gaps."""
    at = bad = 0
    reason, size, finder = "", len(data), Finder(data)
    while at < size:
        try:
            if data[at : at + 3] == MAGIC:
                end, content = _unpack(data, at, finder)
                found = list(_members(content, at, end))
            else:
                end, record = parse_record(data, at, finder)
                found = [record]
        except Broken as e:
            if not reason:
                bad, reason = at, str(e)
            at = min(finder.next(MAGIC, at + 1), finder.next(b"WARC/1.", at + 1))
            continue
        if reason:
            yield bad, at, reason
            reason = ""
        yield from found
        at = end
    if reason:
        yield bad, size, reason


MANIFEST = "file string, n_records long, n_bytes long"


def write_archives(pages: DataFrame, folder: str | None = None) -> str:
    """Writes ``pages`` (page_id, url, html) as archives; returns their folder.

    The response of a payload is found by one aggregate; pages of a payload that
    a large share of all pages has meet it by broadcast, others by a shuffle."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    make_folder(folder)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= LEAST_BYTES)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = join_groups(rows, stored(groups, "payloads"), "digest", "n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, count, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or open_write(f"{folder}/{name}")
                data = member(record(page, url, utf8(text), None if first is None or first == page else first))
                out.write(data)
                count, size = count + 1, size + len(data)
        if out:
            out.close()
            yield arrow_batch(schema, [[name], [count], [size]])

    schema = arrow_schema(MANIFEST)
    found.select("page_id", "url", "html", "first").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


RECORDS = "file string, start long, end long, gap string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, folder: str, files: list[str] | None = None, whole: bool = False) -> DataFrame:
    """A row for each record of the archives and for each quarantined gap, whose
    ``gap`` is the failed check. ``files``: those of the manifest if not given;
    it has one row for each file. ``whole``: a file of the manifest with gaps, or with
    other than its number of records, is an error."""
    wanted = {r["file"]: r["n_records"] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()} if files is None or whole else {}
    files = files if files is not None else list(wanted)
    listed = spark.createDataFrame([(json.dumps([f, wanted.get(f) if whole else None]),) for f in files], "file string").repartition(max(1, len(files)))
    schema = arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spec in batch.column(0).to_pylist():
                (name, want), rows, n = json.loads(spec), [], 0
                with tempfile.TemporaryDirectory() as own, open(as_local(f"{folder}/{name}", own), "rb") as f:
                    if not os.fstat(f.fileno()).st_size:
                        if want:
                            raise ValueError(f"{name}: empty, {want} records written")
                        continue
                    with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                        for x in salvage(data):
                            if isinstance(x, tuple):
                                if want is not None:
                                    raise ValueError(f"{name}: gap at {x[0]}: {x[2]}")
                                rows.append((name, x[0], x[1], x[2], *[None] * 5))
                            else:
                                n += 1
                                digest = base64.b32decode(x.fields["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in x.fields else None
                                size = len(x.payload) if x.payload is not None else int(x.http.get("content-length", 0))
                                rows.append((name, x.offset, x.end, None, _page(x.fields.get("warc-record-id")), size, digest, x.fields.get("warc-type"), _page(x.fields.get("warc-refers-to"))))
                            if len(rows) == 4096:
                                yield arrow_batch(schema, list(zip(*rows, strict=True)))
                                rows = []
                if want is not None and n != want:
                    raise ValueError(f"{name}: {n} records read, {want} written")
                if rows:
                    yield arrow_batch(schema, list(zip(*rows, strict=True)))

    return listed.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back.
    Fails where what is read isn't all that was written."""
    records = read_archives(pages.sparkSession, write_archives(pages), whole=True)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
