"""GIF: LZW code streams, palettes, disposal and transparency, timed frames.

``read_gif`` renders a file to its timed frames by the format's rules.
``gif_frames`` applies it to a media column and adds colour-histogram columns.
``write_gif`` stores 8-bit samples without loss.

LZW (published 1984; the variant that GIF89a fixes): codes widen from one bit
above the sample width to 12 bits as the table grows. Between two clear codes
the width of the k-th code depends on k alone, so a whole stretch is cut from
the bits by one array operation before its strings are looked up.

Edge cases: a null text is an empty payload of 64 zero bytes; a file that is
null, cut off or not a GIF gives no frames and an ``error`` instead of a crash;
so does one whose screen or frame has more than MOST_PIXELS, which its bytes may
name without holding them; codes past the table end the frame, whose missing pixels stay as they were;
equal bytes give equal frames and columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batch, arrow_schema, stored, utf8

MAX_CODES = 4096
#: Rows of a stored frame: a GIF's height is a 16-bit number. Pixels of a screen or
#: frame that is rendered, 256 MB.
MAX_ROWS, MOST_PIXELS = 65_535, 1 << 26


def _widths(size: int) -> np.ndarray:
    """Width of the k-th code after a clear code, for k up to a full table."""
    clear = 1 << size
    # Before the k-th code the reader's table has clear + 2 + max(0, k - 1) entries.
    entries = clear + 2 + np.maximum(np.arange(MAX_CODES - clear) - 1, 0)
    return np.minimum(12, np.floor(np.log2(entries)).astype(np.int64) + 1)


_PLAN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _plan(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and starting bits of the codes between two clear codes."""
    if size not in _PLAN:
        w = _widths(size)
        _PLAN[size] = w, np.concatenate([[0], np.cumsum(w)])
    return _PLAN[size]


def _cut(data: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths at the given bits; ``data`` ends in two spare bytes."""
    byte = at >> 3
    word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
    return (word >> (at & 7)) & ((1 << widths) - 1)


def lzw_codes(data: bytes, size: int) -> Iterator[list[int]]:
    """The code stretches of a stream, without its clear and end codes. Codes
    after a full table come one at a time, as -1 - code."""
    clear, total = 1 << size, 8 * len(data)
    source = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int64)
    widths, starts = _plan(size)
    at = 0
    while at + size + 1 <= total:
        fit = int(np.searchsorted(starts, total - at, "right")) - 1
        codes = _cut(source, at + starts[:fit], widths[:fit])
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            k = int(stop[0])
            at += int(starts[k] + widths[k])
            if k:
                yield codes[:k].tolist()
            if codes[k] == clear + 1:
                return
            continue
        at += int(starts[fit])
        yield codes.tolist()
        while fit == len(widths) and at + 12 <= total:  # a full table stays until cleared
            code = int(_cut(source, np.array([at]), np.array([12]))[0])
            at += 12
            if code == clear + 1:
                return
            if code == clear:
                break
            yield [-1 - code]


def lzw_decode(data: bytes, size: int) -> bytes:
    """Samples of a code stream; as far as it goes if it is damaged."""
    clear, out = 1 << size, []
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    table: list[bytes] = []
    last = b""
    for codes in lzw_codes(data, size):
        if codes and codes[0] < 0:  # past a full table: no new entries
            code = -1 - codes[0]
            if code >= len(table):
                return b"".join(out)
            out.append(table[code])
            continue
        table, last = singles.copy(), b""
        new, put = table.append, out.append
        n = clear + 2
        for code in codes:
            if code < n:
                text = table[code]
                if last:
                    new(last + text[:1])
                    n += 1
            elif code == n and last:
                text = last + last[:1]
                new(text)
                n += 1
            else:
                return b"".join(out)
            put(text)
            last = text
    return b"".join(out)


def lzw_encode(samples: bytes, size: int) -> bytes:
    """A code stream that clears its table whenever it is full."""
    clear = 1 << size
    widths, _ = _plan(size)
    stretches, codes = [], []
    if samples:
        full, n, table = MAX_CODES - 1, clear + 2, {}
        get, put = table.get, codes.append
        prefix = samples[0]
        for sample in memoryview(samples)[1:]:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if n < full:
                table[key] = n
                n += 1
            else:
                put(clear)
                stretches.append(codes)
                codes = []
                put = codes.append
                table.clear()
                n = clear + 2
            prefix = sample
        put(prefix)
    codes.append(clear + 1)
    stretches.append(codes)
    every = np.concatenate([[clear], *stretches]).astype(np.int64)
    used = np.concatenate([[size + 1], *[widths[: len(c)] for c in stretches]])
    ends = np.cumsum(used)
    at = ends - used
    word, byte = every << (at & 7), at >> 3
    out = np.zeros((int(ends[-1]) + 7 >> 3) + 2)
    for shift in (0, 8, 16):  # the bits of two codes never meet, so sums are unions
        part = np.bincount(byte, word >> shift & 255)
        out[shift >> 3 : (shift >> 3) + len(part)] += part
    return out[:-2].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    cut = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes([len(c)]) + c for c in cut) + b"\0"


#: Grey levels: sample and palette index are equal.
GREYS = bytes(v for i in range(256) for v in (i, i, i))


def write_gif(samples: bytes, width: int = 64, delay: int = 10) -> bytes:
    """Samples in rows of ``width``, the palette index of each its value; more
    than 65,535 rows go on in further frames."""
    per = width * MAX_ROWS
    frames = [samples[i : i + per] for i in range(0, len(samples), per)] or [b""]
    height = len(frames[0]) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREYS]
    for f in frames:
        if len(frames) > 1:
            out.append(b"\x21\xf9\x04\x04" + struct.pack("<HBB", delay, 0, 0))
        out += [b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(f) // width, 0), b"\x08", _blocks(lzw_encode(f, 8))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    palette: np.ndarray
    start_ms: int = 0
    canvas: np.ndarray | None = None


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width and height of the screen, and the frames with their indices."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MOST_PIXELS:
        raise ValueError(f"screen of {width} x {height}")
    at = 13
    palette = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames: list[Frame] = []
    delay = disposal = 0
    transparent = None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = 10 * (body[1] | body[2] << 8)
                transparent = body[3] if body[0] & 1 else None
            at = end
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if w * h > MOST_PIXELS:
                raise ValueError(f"frame of {w} x {h}")
            own = palette
            if flags & 0x80:
                n = 2 << (flags & 7)
                own = np.zeros((256, 3), np.uint8)
                own[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            size = data[at]
            if not 1 <= size <= 8:
                raise ValueError(f"code size {size}")
            body, at = blocks(at + 1)
            got = np.frombuffer(lzw_decode(body, size)[: w * h], np.uint8)
            indices = np.full(w * h, -1, np.int16) if len(got) < w * h else got
            if len(got) < w * h:
                indices[: len(got)] = got
            indices = indices.reshape(h, w)
            if flags & 0x40:
                rows = np.empty_like(indices)
                rows[_interlaced(h)] = indices
                indices = rows
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, indices, own))
            delay = disposal = 0
            transparent = None
        else:
            raise ValueError(f"block {data[at]:#x} at {at}")
    return width, height, frames


def read_gif(data: bytes) -> list[Frame]:
    """Frames with the screen (height, width, 4) as shown during each: pixels
    over the one before, transparent ones skipped; afterwards the frame stays,
    is cleared, or gives way to what was there, as its disposal says."""
    width, height, frames = parse_gif(data)
    screen, now = np.zeros((height, width, 4), np.uint8), 0
    for f in frames:
        before = screen.copy() if f.disposal == 3 else None
        rows, columns = slice(f.top, min(f.top + f.height, height)), slice(f.left, min(f.left + f.width, width))
        part = f.indices[: max(0, rows.stop - f.top), : max(0, columns.stop - f.left)]
        seen = part >= 0 if f.transparent is None else (part >= 0) & (part != f.transparent)
        colours = np.concatenate([f.palette[np.maximum(part, 0)], np.full((*part.shape, 1), 255, np.uint8)], axis=2)
        screen[rows, columns][seen] = colours[seen]
        f.start_ms, f.canvas = now, screen.copy()
        now += f.delay_ms
        if f.disposal == 2:
            screen[rows, columns] = 0
        elif f.disposal == 3:
            screen = before
    return frames


def colour_histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 64 bins, two bits for each of red, green, blue."""
    p = pixels.reshape(-1, 4)
    p = p[p[:, 3] > 0] >> 6
    return np.bincount((p[:, 0] << 4) | (p[:, 1] << 2) | p[:, 2], minlength=64)


FRAMES = "id long, frame int, start_ms int, delay_ms int, width int, height int, pixels binary, histogram array<long>, error string"


def gif_frames(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each timed frame of the GIFs in ``column``: its place and time,
    the rendered RGBA pixels and their colour histogram."""

    def render(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    frames, error = read_gif(data or b""), None
                except (ValueError, IndexError, struct.error) as e:
                    frames, error = [], str(e)
                rows = [{"id": key, "frame": i, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "pixels": f.canvas.tobytes(), "histogram": colour_histogram(f.canvas).tolist(), "error": None} for i, f in enumerate(frames)]
                rows = rows or [{"id": key, "error": error or "no frames"}]
                for row in rows:
                    yield pa.RecordBatch.from_pylist([row], schema)

    schema = arrow_schema(FRAMES)
    return media.select(id_column, column).mapInArrow(render, FRAMES)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8, and it with zeros up to a multiple of 64."""
    data = utf8(text)
    return len(data), data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a GIF, written to the shared folder."""

    def store(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                made = [(n, write_gif(p)) for n, p in map(payload_of, texts[i : i + 64])]
                yield arrow_batch(schema, [ids[i : i + 64].cast(pa.int64()), [n for n, _ in made], [m for _, m in made]])

    ddl = "doc_id long, n_bytes long, media binary"
    schema = arrow_schema(ddl)
    return stored(docs.select("doc_id", "text").mapInArrow(store, ddl), "media")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, mean_level double, histogram array<long>"


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored GIFs back, as rendered: a frame's samples are the levels of
    its part of the screen. ``feature`` is their histogram in 64 bins of four grey
    levels, as per mille of the frame in hexadecimal, three digits a bin;
    ``histogram`` is the colour histogram of those parts."""

    def read(batches):
        for batch in batches:
            rows = []
            for key, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                frames = read_gif(data)
                shown = [f.canvas[f.top : f.top + f.height, f.left : f.left + f.width] for f in frames]
                payload = b"".join(part[..., 0].tobytes() for part in shown)
                levels = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                colours = sum(map(colour_histogram, shown))
                bins = levels.reshape(64, 4).sum(axis=1)
                feature = "".join(f"{int(b):03x}" for b in np.rint(1000 * bins / len(payload)))
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), float(levels @ np.arange(256) / len(payload)), colours.tolist()))
            yield arrow_batch(schema, list(zip(*rows, strict=True)) or [[]] * len(schema))

    schema = arrow_schema(DIGEST)
    return media.mapInArrow(read, DIGEST)
