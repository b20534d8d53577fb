"""Token files, WARC archives and GIF media: exact round trips, damage, edges."""

import hashlib
import os
import random
import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pytest

from lodestar.llm import media, token_files, warc

TEXTS = [None, "", "Hello, World! don't", "héllo\x0bWÖRLD x <|endoftext|> y", "ça va\n\n" * 50, "a" * 30_000, "Σίσυφος ΟΔΟΣ 123 ４５", "same", "same"]


def tokenizer():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("word_bpe_49k.json")


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path, rng = tokenizer(), random.Random(1)
    plain = Tokenizer.from_file(path)
    alphabet = "aB É.,!'\n\t\r0<|>ßı́"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(200)]
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int")
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, token_files.write_tokens(df, path, 2)).collect()}
    start = 0
    for i, text in sorted(zip(ids, texts, strict=True)):
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_token_files_ties_and_empty(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n")], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_tokens(spark, token_files.write_tokens(df, tokenizer(), 2)).collect())
    assert got == [(0, None, 2), (2, 5, 2), (4, 5, 2)]
    assert token_files.read_tokens(spark, token_files.write_tokens(df.limit(0), tokenizer(), 2)).count() == 0


def test_whole_text_mode_equals_word_mode():
    path = tokenizer()
    texts = [t or "" for t in TEXTS]
    assert token_files.WordEncoder(path, by_word=False).encode(texts) == token_files.WordEncoder(path).encode(texts)


def pages(spark):
    big, rng = "<p>copy</p>" * 200, random.Random(2)
    rows = [(i, f"http://h/{i}", big) for i in (3, 9, 5)] + [(20, None, None), (21, "u\r\nx", ""), (22, "u", "short"), (23, "u", "short"), (24, "é", "ü" * 600), (25, "é", "ü" * 600), (None, "n", big), (9, "again", big)]
    rows += [(100 + i, "u", "".join(rng.choice("ab\r\n ") for _ in range(2000)) + "WARC/1.1\r\n") for i in range(30)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    got = sorted((tuple(r) for r in warc.round_trip(df.withColumn("digest", df.url)).collect()), key=str)
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            first[data] = max(first.get(data, i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        response = first.get(data, i) == i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else first[data]))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_salvage_after_damage(spark, tmp_path):
    records = [warc.record(i, "u", f"payload {i} ".encode() * 50, None) for i in range(6)]
    zipped = [warc.member(r) for r in records]
    bad = bytearray(zipped[2])
    bad[len(bad) // 2] ^= 0xFF
    data = zipped[0] + b"junk\x1f\x8b\x08junk" + zipped[1] + bytes(bad) + zipped[3] + zipped[4][:40] + zipped[5] + b"tail"
    found = list(warc.salvage(data))
    ids = [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)]
    gaps = [x[:2] for x in found if isinstance(x, tuple)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    ends = np.cumsum([len(zipped[0]), 11, len(zipped[1]), len(bad), len(zipped[3]), 40, len(zipped[5]), 4]).tolist()
    assert gaps == [(ends[0], ends[1]), (ends[2], ends[3]), (ends[4], ends[5]), (ends[6], ends[7])]
    plain = records[0] + records[1].replace(b"payload", b"PAYLOAD", 1) + records[2][:-30] + records[3]
    assert [x.fields["warc-record-id"] for x in warc.salvage(plain) if isinstance(x, warc.Record)] == ["<urn:page:0>", "<urn:page:3>"]
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path), ["x.warc.gz", "empty.warc.gz"]).collect()
    assert len(rows) == 8 and sum(r["gap"] is not None for r in rows) == 4 and sum(r["end"] - r["start"] for r in rows) == len(data)


def test_salvage_covers_random_damage():
    rng, zipped = random.Random(3), [warc.member(warc.record(i, "u", os.urandom(300), None)) for i in range(20)]
    for _ in range(30):
        data = bytearray(b"".join(zipped))
        for _ in range(3):
            at = rng.randrange(len(data))
            data[at : at + rng.randrange(40)] = os.urandom(rng.randrange(30))
        spans = [(x.offset, x.end) if isinstance(x, warc.Record) else x[:2] for x in warc.salvage(bytes(data))]
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(bytes(data))) >= 14


def test_lzw_round_trip_and_deferred_clear():
    rng = random.Random(4)
    for n in (0, 1, 2, 64, 5000, 120_000):
        for letters in (1, 3, 60, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert media.lzw_decode(media.lzw_encode(data, 8), 8) == data
    # A stream that never clears its full table: codes stay 12 bits wide.
    data = bytes(rng.randrange(4) for _ in range(60_000))
    table, prefix, codes = {}, data[0], [4]
    for s in data[1:]:
        key = (prefix, s)
        if key in table:
            prefix = table[key]
        else:
            codes.append(prefix)
            if len(table) + 6 < 4096:
                table[key] = len(table) + 6
            prefix = s
    codes += [prefix, 5]
    bits, size, known = "", 3, 6
    for k, c in enumerate(codes):
        if k > 2 and known < 4096:
            known += 1
            if known == 1 << size and size < 12:
                size += 1
        bits = format(c, f"0{size}b") + bits
    raw = int(bits, 2).to_bytes(-(-len(bits) // 8), "little")
    assert media.lzw_decode(raw, 2) == data


def gif(*frames, size=(4, 3), palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff"):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette
    for left, top, w, h, samples, disposal, transparent, delay, flags in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + struct.pack("<HB", delay, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02" + media._blocks(media.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_gif_disposal_transparency_and_interlace():
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    frames = media.read_gif(gif((0, 0, 4, 3, [1] * 12, 1, None, 5, 0), (1, 1, 2, 1, [2, 0], 2, 0, 7, 0), (0, 0, 1, 1, [3], 3, None, 1, 0), (3, 2, 1, 1, [2], 0, None, 1, 0)))
    pixel = lambda f, y, x: tuple(f.canvas[y, x].tolist())
    assert [f.start_ms for f in frames] == [0, 50, 120, 130]
    assert pixel(frames[1], 1, 1) == green and pixel(frames[1], 1, 2) == red  # a transparent pixel shows what was there
    assert pixel(frames[2], 1, 1) == pixel(frames[2], 1, 2) == clear and pixel(frames[2], 0, 0) == blue  # cleared after frame 1
    assert pixel(frames[3], 0, 0) == red and pixel(frames[3], 2, 3) == green  # restored after frame 2
    rows = media.read_gif(gif((0, 0, 1, 9, [0, 2, 1, 3, 1, 2, 3, 0, 1], 0, None, 0, 0x40), size=(1, 9)))[0].indices.ravel()
    assert [rows[i] for i in (0, 8, 4, 2, 6, 1, 3, 5, 7)] == [0, 2, 1, 3, 1, 2, 3, 0, 1]


def test_media_digest_and_frames(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*TEXTS, "x" * 64, "y" * 65])], "doc_id long, text string, media int")
    stored = media.store_texts(df)
    got = {r["doc_id"]: r for r in media.media_digest(stored).collect()}
    for i, text in enumerate([*TEXTS, "x" * 64, "y" * 65]):
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[7]["media_sha256"] == got[8]["media_sha256"] and got[7]["feature"] == got[8]["feature"]
    bad = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, b"nothing"), (4, media.write_gif(b"\x10" * 64)[:-40]), (5, media.write_gif(b"\x10" * 64))], "doc_id long, media binary")
    frames = {r["id"]: r for r in media.gif_frames(bad).collect()}
    assert all(frames[i]["error"] for i in (1, 2, 3, 4)) and frames[5]["error"] is None and frames[5]["histogram"][0] == 64


def test_many_rows_become_frames(monkeypatch):
    monkeypatch.setattr(media, "MAX_ROWS", 3)
    payload = bytes(range(256)) * 2
    _, _, frames = media.parse_gif(media.write_gif(payload))
    assert len(frames) == 3 and b"".join(f.indices.tobytes() for f in frames) == payload


def test_another_reader_sees_the_same_samples(spark):
    """The JVM's own GIF reader as a check from outside."""
    jvm, rng = spark._jvm, random.Random(6)
    for n, letters in ((64, 2), (64 * 40, 256), (64 * 900, 30)):
        payload = bytes(rng.randrange(letters) for _ in range(n))
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(media.write_gif(payload))))
        assert (image.getWidth(), image.getHeight()) == (64, n // 64)
        assert bytes(image.getRaster().getDataBuffer().getData()) == payload


def test_warc_keeps_pages_of_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "x" * (1 << 21), "<p>"), (2, "http://b/", "<p>")], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.round_trip(pages).collect()) == [1, 2]


def test_warc_round_trip_fails_on_missing_records(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(4)], "page_id long, url string, html string")
    write = warc.write_archives

    def damaged(pages):
        folder = write(pages)
        name = urlparse(folder).path + "/" + spark.read.parquet(f"{folder}/manifest").first()["file"]
        with open(name, "r+b") as f:
            f.truncate(os.path.getsize(name) - 20)
        return folder

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="gap at"):
        warc.round_trip(pages).collect()


def test_media_digest_takes_rendered_frames(spark):
    data = media.write_gif(bytes([16, 200] * 32))
    at = 13 + len(media.GREYS)
    data = data[:at] + b"\x21\xf9\x04\x01\x00\x00\x10\x00" + data[at:]  # 16 is transparent
    df = spark.createDataFrame([(1, 64, data)], "doc_id long, n_bytes long, media binary")
    r = media.media_digest(df).first()
    assert r["payload_sha256"] == hashlib.sha256(bytes([0, 200] * 32)).hexdigest()
    assert sum(r["histogram"]) == r["histogram"][63] == 32


def test_a_tokenizer_that_keeps_spaces_encodes_whole_texts(spark):
    from tokenizers import Tokenizer

    tokens = pytest.importorskip("public_tokenizers")
    path = tokens.path("byte_bpe_50k.json")
    assert not token_files.WordEncoder(path).by_word and token_files.WordEncoder(tokenizer()).by_word
    df = spark.createDataFrame([(1, "Two  words\nand MORE"), (2, None)], "doc_id long, text string")
    got = token_files.read_tokens(spark, token_files.write_tokens(df, path, 0)).where("doc_id = 1").first()
    want = Tokenizer.from_file(path).encode("Two  words\nand MORE", add_special_tokens=False).ids + [0]
    assert (got["n_tokens"], got["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_many_null_ids_are_spread_and_kept(spark):
    df = spark.createDataFrame([(None, f"n{i}") for i in range(300)] + [(7, f"s{i}") for i in range(300)], "doc_id long, text string")
    got = token_files.read_tokens(spark, token_files.write_tokens(df, tokenizer(), 2)).collect()
    assert sorted(r["doc_id"] is None for r in sorted(got, key=lambda r: r["start"]))[300:] == [True] * 300
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None] * 300 + [7] * 300


def test_salvage_of_members_with_several_records():
    a, b, c = (warc.record(i, "u", b"x" * 50, None) for i in (1, 2, 3))
    found = list(warc.salvage(warc.member(a + b + c)))
    assert [x.fields["warc-record-id"] for x in found] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    broken = b.replace(b"xxx", b"xyx", 1)
    found = list(warc.salvage(warc.member(a + broken + c) + warc.member(b)))
    assert [x[2] if isinstance(x, tuple) else x.fields["warc-record-id"] for x in found] == ["<urn:page:1>", "in member: block digest", "<urn:page:3>", "<urn:page:2>"]


def test_salvage_searches_a_file_once():
    import time

    good, took = warc.member(warc.record(1, "u", b"x", None)), []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        found = list(warc.salvage(warc.MAGIC * n + b"WARC/1.1\r\nx" * n + good))
        took.append(time.perf_counter() - began)
        assert len(found) == 2 and isinstance(found[1], warc.Record)
    assert took[1] < 10 * took[0]  # four times the data


def test_huge_screens_are_errors(spark):
    data = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0, 0, 0) + b"\x3b"
    frame = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65_535, 65_535, 0) + b"\x08\x00\x3b"
    df = spark.createDataFrame([(1, data), (2, frame)], "doc_id long, media binary")
    got = {r["id"]: r["error"] for r in media.gif_frames(df).collect()}
    assert got[1].startswith("screen of 65535") and got[2].startswith("frame of 65535")
