"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where more than half of its shingle hashes have it
set. Two fingerprints link when they differ in at most THRESHOLD bits.

Anchors (after Afrati et al., "Fuzzy joins using MapReduce", 2012): the code
words of two binary Golay codes [23,12], each over 23 of the 64 bits. A Golay
code is perfect with covering radius 3: every 23-bit string has exactly one
code word within 3 bits, so every fingerprint has one home among the 2**24
anchors. A fingerprint is replicated to every anchor within covering radius
plus threshold: to each whose excess over radius 3, added over both blocks, is
at most THRESHOLD. If u and v differ in d1 and d2 bits of the blocks, v lies
within 3 + d1 and 3 + d2 of u's home, so v is there: no link is lost. At an
anchor its residents are compared with the fingerprints that reach it.

All this runs on distinct fingerprints, so exact copies cost nothing, and a
fingerprint has at most 2,080 others within 2 bits, so links grow with the
number of distinct fingerprints and not with the square of a group.

A home where many fingerprints differ in the 18 bits that no block covers is
compared by thirds of those bits: two that link differ in at most two bits, so
they agree in one of three.

Near copies (``near_copies``, for the pipeline) are another relation: texts whose
sets of five-word shingles have a Jaccard similarity of LEAST or more. At 0.8 two
fingerprints differ in some ten of 64 bits, sixteen and more at times; anchors
that cover such a radius would receive nearly every fingerprint. So fingerprints of the
sets within THRESHOLD bits, found by the anchors, are candidates, and the pairs beyond
that radius come from MinHash. Texts of equal sets form a class. Classes meet where all
KEY_HASHES MinHashes of one of KEYS keys agree, which a pair of similarity 0.8
misses with a probability of (1 - 0.8**4)**20, 3 in 100,000, and a closer one more
rarely. What meets is checked on its sets of shingle hashes: first each member with the one
hub that most of its keys name; then, of keys whose members are not yet one
component, everything across components, inside a task. A key with many shingles
is dealt in blocks and every two of its blocks meet in a task of their own, so no
task grows with a group. Only links leave the tasks, at most one for each two
components there; no pair that could join two components is left unchecked.

Edge cases: null and empty texts have fingerprint 0 (an empty set) and are linked
like any other; texts with fewer words than a shingle are one shingle; a null
doc_id gives a null component and takes part in no link of its own; rows with
equal ids form one document, so they link whatever their texts; other columns are
ignored, and carried by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, give_back, join_groups, stored, words_of
from .graph import components

THRESHOLD, RADIUS, BLOCK, GENERATOR = 2, 3, 23, 0b110001110101
SEED, SHINGLE = 42, 3
#: Near copies: shingle width, least Jaccard similarity, MinHash keys of a text and hashes of a key.
COPY_SHINGLE, LEAST, KEYS, KEY_HASHES = 5, 0.8, 20, 4
#: Shingles of a block of a key; members that meet one copy of a hub; residents of an anchor that is compared whole.
BLOCK_HASHES, SLICE, MOST_RESIDENTS = 1 << 18, 256, 1024
#: Bytes of shingle hashes that are voted on at once.
BLOCK_BYTES = 1 << 20


def shingle_hashes(text: str | None, width: int = SHINGLE) -> bytes:
    """Big-endian XXH64 values of the word shingles, one after another."""
    words = words_of(text)
    if not words:
        return b""
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))


def majority(hashes: list[bytes]) -> np.ndarray:
    """For each text's hashes, the 64 bits that over half of them have set."""
    counts = np.array([len(h) // 8 for h in hashes])
    out, some = np.zeros(len(hashes), np.uint64), np.flatnonzero(counts)
    if not len(some):
        return out
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, 64)
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * votes > counts[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, done = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist(), []
            part, held = [], 0
            for text in texts:
                part.append(shingle_hashes(text))
                held += len(part[-1])
                if held > BLOCK_BYTES:
                    done.append(majority(part))
                    part, held = [], 0
            done.append(majority(part))
            yield arrow_batch(schema, [ids, np.concatenate(done).view(np.int64)])

    schema = arrow_schema("doc_id long, fp long")
    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, fp long")


def syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial: 0 for code words."""
    out = np.zeros(len(values), np.int64)
    rest = 1
    for i in range(BLOCK):
        out ^= np.where(values >> i & 1, rest, 0)
        rest <<= 1
        if rest >> 11:
            rest ^= GENERATOR
    return out


@cache
def patterns() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each excess 0..THRESHOLD: (start, count, errors) by syndrome, where
    value ^ error are the code words within RADIUS + excess, but no nearer ones."""
    every = [(w, sum(1 << i for i in c)) for w in range(RADIUS + THRESHOLD + 1) for c in combinations(range(BLOCK), w)]
    weight, error = np.array(every).T
    syndrome, out = syndromes(error), []
    for excess in range(THRESHOLD + 1):
        own = np.maximum(weight - RADIUS, 0) == excess
        order = np.argsort(syndrome[own], kind="stable")
        count = np.bincount(syndrome[own], minlength=1 << 11)
        out.append((np.cumsum(count) - count, count, error[own][order]))
    return out


def _blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << BLOCK) - 1
    return fps & mask, fps >> BLOCK & mask


def homes(fps: np.ndarray) -> np.ndarray:
    start, _, errors = patterns()[0]
    a, b = (v ^ errors[start[syndromes(v)]] for v in _blocks(fps))
    return a << BLOCK | b


def reached(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that a fingerprint is replicated to."""
    a, b = _blocks(fps)
    sa, sb = syndromes(a), syndromes(b)
    rows, anchors = [], []
    for i, (start_a, count_a, error_a) in enumerate(patterns()):
        for start_b, count_b, error_b in patterns()[: THRESHOLD + 1 - i]:
            na, nb = count_a[sa], count_b[sb]
            row = np.repeat(np.arange(len(fps)), na * nb)
            k = np.arange(len(row)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            ka, kb = np.divmod(k, nb[row])
            rows.append(row)
            anchors.append((a[row] ^ error_a[start_a[sa[row]] + ka]) << BLOCK | (b[row] ^ error_b[start_b[sb[row]] + kb]))
    return np.concatenate(rows), np.concatenate(anchors)


def links(classes: DataFrame) -> DataFrame:
    """a, b: representatives of distinct fingerprints (fp, rep) within THRESHOLD."""
    ddl = "anchor long, fp long, rep long"
    schema = arrow_schema(ddl)

    def settle(batches, everywhere: bool):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps, reps = (np.asarray(c) for c in batch.slice(at, 2048).columns)
                row, anchor = reached(fps) if everywhere else (np.arange(len(fps)), homes(fps))
                yield arrow_batch(schema, [anchor, fps[row], reps[row]])

    own = classes.where("rep is not null").select("fp", "rep")
    resident = stored(own.mapInArrow(lambda x: settle(x, False), ddl), "residents")
    # A fingerprint visits many anchors, which Spark's estimates don't know: neither
    # side of these joins is small enough to be broadcast because its files are.
    visitor = own.mapInArrow(lambda x: settle(x, True), ddl)
    near = f"h.fp < v.fp and bit_count(h.fp ^ v.fp) <= {THRESHOLD}"
    pair = F.col("h.rep").alias("a"), F.col("v.rep").alias("b")
    full = resident.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST_RESIDENTS).select("anchor")
    full = stored(full, "full-anchors")
    if full.isEmpty():
        return resident.hint("merge").alias("h").join(visitor.alias("v"), F.expr(f"h.anchor = v.anchor and {near}")).select(*pair)
    others = resident.join(full, "anchor", "left_anti").hint("merge").alias("h").join(visitor.alias("v"), F.expr(f"h.anchor = v.anchor and {near}")).select(*pair)

    def thirds(rows: DataFrame) -> DataFrame:
        """Each fingerprint under every third of its bits beyond the blocks."""
        beyond = F.shiftrightunsigned("fp", 2 * BLOCK)
        parts = [F.shiftright(beyond, 6 * k).bitwiseAND(63) for k in range(3)]
        return rows.join(full, "anchor").select("*", F.posexplode(F.array(*parts)).alias("k", "part"))

    # A pair that agrees in several thirds is taken from the first of them.
    first = " and ".join(f"(h.k <= {k} or ((h.fp ^ v.fp) >>> {2 * BLOCK + 6 * k}) & 63 != 0)" for k in range(2))
    split = thirds(resident).hint("merge").alias("h").join(thirds(visitor).alias("v"), F.expr(f"h.anchor = v.anchor and h.k = v.k and h.part = v.part and {near} and {first}"))
    return others.unionByName(split.select(*pair))


def same_id_links(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """a, b: edges that make rows with equal ids one document: from an id that
    occurs in several classes to the representative of each."""
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo < hi").select("doc_id")
    found = rows.join(several, "doc_id").select("doc_id", key).distinct().join(classes.select(key, "rep"), key)
    return found.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, class_size of every document."""
    fps = stored(fingerprints(docs), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size")), "classes")
    roots = components(links(classes).unionByName(same_id_links(fps, classes, "fp")))
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "class_size", F.coalesce("root", "rep").alias("component_id"))
    found = join_groups(fps, named, "fp", "class_size")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own, "class_size")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.frombuffer(shingle_hashes(text, width), ">u8").astype(np.uint64))


def minhash_keys(sets: list[np.ndarray]) -> np.ndarray:
    """KEYS keys for each of the sets, none of them empty."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, KEYS * KEY_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, KEYS * KEY_HASHES, dtype=np.uint64)
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), KEYS), np.int64)
    for k in range(KEYS):
        at = range(k * KEY_HASHES, (k + 1) * KEY_HASHES)
        rows = np.stack([np.minimum.reduceat((flat ^ masks[i]) * factors[i], starts) for i in at], axis=1)
        out[:, k] = [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for r in rows]
    return out


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, same (a digest of the text's shingle set), n (its size), keys, fp (its
    fingerprint)."""
    ddl = "doc_id long, same binary, n long, keys array<long>, fp long"
    schema = arrow_schema(ddl)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist(), 0
            while at < len(texts):
                part, held = [], 0
                while at + len(part) < len(texts) and held < BLOCK_BYTES:
                    part.append(shingle_set(texts[at + len(part)], width))
                    held += part[-1].nbytes
                some = [s for s in part if len(s)]
                found = iter(minhash_keys(some).tolist() if some else [])
                yield arrow_batch(schema, [ids.slice(at, len(part)), [xxhash.xxh128_digest(s.tobytes()) for s in part], [len(s) for s in part], [next(found) if len(s) else [] for s in part], majority([s.astype(">u8").tobytes() for s in part]).view(np.int64)])
                at += len(part)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(each, ddl)


def packed(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of sorted shingle hashes: of two sets of 500, one pair of
    different shingles in four million sets agrees there."""
    return np.ascontiguousarray((hashes >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.unique(out.view("<u8").ravel())


def class_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """same, keys, set (its shingle hashes, ``packed``) of the texts of documents in
    ``reps`` (doc_id), stored."""
    ddl = "same binary, keys array<long>, set binary"
    schema = arrow_schema(ddl)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, width)
                if len(own):
                    yield arrow_batch(schema, [[xxhash.xxh128_digest(own.tobytes())], minhash_keys([own]).tolist(), [packed(own)]])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(reps, "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(each, ddl)
    return stored(found.groupBy("same").agg(F.first("keys").alias("keys"), F.first("set").alias("set")), "copy-sets")


def hub_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b of the rows of ``pairs`` (stored: same and a of a member, hub and b of
    its hub) whose sets are similar. A hub's set is copied for every SLICE members,
    so a hub of many is met in many tasks."""
    counts = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    hubs = counts.join(sets.select(F.col("same").alias("hub"), F.col("set").alias("hub_set")), "hub").select("hub", "hub_set", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    dealt = join_groups(pairs, counts.select("hub", "n", slices.alias("slices")), "hub", "n").withColumn("slice", F.pmod(F.xxhash64("same"), F.col("slices")).cast("int"))
    met = dealt.join(sets.select("same", "set"), "same").join(hubs, ["hub", "slice"]).select("a", "b", "set", "hub_set")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("set"), batch.column("hub_set"), strict=True):
                own, other = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                common = len(np.intersect1d(own, other, assume_unique=True))
                near.append(common >= least * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))
        give_back()

    return met.mapInArrow(each, "a long, b long")


def links_across(key: int, sides: np.ndarray, reps: np.ndarray, roots: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between members of a key that have different roots, one for each two
    components that they join. ``sides``: the blocks of the members; of two blocks
    only pairs across are compared. A pair is compared under the first key that it
    shares. A member of whose shingles too few occur in others is left out."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    _, term, met = np.unique(flat, return_inverse=True, return_counts=True)
    able = np.add.reduceat(met[term] > 1, starts) >= least * sizes
    roots, two, found = roots.copy(), sides.min() != sides.max(), []
    first = keys == key  # each key's place among a member's keys is fixed
    place = int(first.any(axis=0).argmax())
    flags = np.zeros(len(met), np.int32)
    for i in np.flatnonzero(able):
        j = np.flatnonzero(able & (roots != roots[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])))
        j = j[(j > i) & ((sides[j] != sides[i]) | (not two))]
        j = j[~(keys[j, :place] == keys[i, :place]).any(axis=1)]
        if not len(j):
            continue
        flags[term[starts[i] : starts[i] + sizes[i]]] = 1
        at = np.repeat(starts[j] - (np.cumsum(sizes[j]) - sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
        common = np.add.reduceat(flags[term[at]], np.cumsum(sizes[j]) - sizes[j])
        flags[term[starts[i] : starts[i] + sizes[i]]] = 0
        for k in j[common >= least * (sizes[i] + sizes[j] - common)]:
            if roots[k] != roots[i]:
                found.append((int(reps[i]), int(reps[k])))
                roots[roots == roots[k]] = roots[i]
    return found


def open_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links of ``members`` (key, same, rep, root, mass: the shingles of the
    key's members) across the components of a key."""
    blocks = F.ceil(F.col("mass") / BLOCK_HASHES).cast("int")
    own = members.select("key", "same", "rep", "root", blocks.alias("blocks")).withColumn("side", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Of several blocks each two meet, and a block meets itself.
    dealt = own.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep", "root", "same")
    dealt = dealt.join(sets.hint("merge"), "same").drop("same").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    schema = arrow_schema("a long, b long")

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        if len(rows) > 1:
            key, side, reps, roots = (rows.column(c).to_numpy() for c in ("key", "side", "rep", "root"))
            keys = np.array(rows.column("keys").to_pylist(), np.int64)
            sets = [unpacked(x.as_buffer()) for x in rows.column("set")]
            found = links_across(int(key[0]), side, reps, roots, keys, sets, least)
            if found:
                yield arrow_batch(schema, list(zip(*found, strict=True)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(marks[a]) != name:
                    yield from compare(held)
                    held = []
                name = tuple(marks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from compare(held)

    return dealt.mapInArrow(each, "a long, b long")


def print_pairs(classes: DataFrame) -> DataFrame:
    """rep, other: classes whose fingerprints link: those of equal ones with the
    first of them, and the first ones of fingerprints within THRESHOLD bits."""
    own = classes.where("rep is not null and n > 0").select("fp", "rep")
    prints = stored(own.groupBy("fp").agg(F.min("rep").alias("rep")), "copy-prints")
    equal = own.join(prints.withColumnRenamed("rep", "other"), "fp").where("rep != other").select("rep", "other")
    return equal.unionByName(links(prints).select(F.col("a").alias("rep"), F.col("b").alias("other")))


def near_copies(docs: DataFrame, width: int = COPY_SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, component_id, class_size of every document; components of texts
    whose shingle sets have a Jaccard similarity of ``least`` or more."""
    rows = stored(shingle_sets(docs, width), "shingle-sets")
    classes = stored(rows.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "copy-classes")
    keyed = classes.where("rep is not null").select("same", "rep", "n", F.explode("keys").alias("key"))
    hub = F.min(F.struct(F.xxhash64("same").alias("h"), "same", "rep", "n")).alias("hub")
    met = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), hub).where("size > 1")
    met = stored(met.select("key", "size", "mass", F.col("hub.same").alias("hub"), F.col("hub.rep").alias("b"), F.col("hub.n").alias("m")), "copy-keys")
    members = stored(join_groups(stored(keyed.join(met.select("key"), "key", "left_semi"), "copy-met"), met, "key", "size"), "copy-members")
    # Sets whose sizes are further apart than ``least`` can't be that similar.
    fit = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")
    side = classes.where("n > 0").select("rep", "same", "n")
    printed = print_pairs(classes).join(side, "rep").join(side.toDF("other", "hub", "m"), "other").where(fit)
    printed = stored(printed.select("same", F.col("rep").alias("a"), "hub", F.col("other").alias("b")), "copy-printed")
    # Stored, so that its size is known and it is broadcast where that is small.
    ids = members.select("rep").union(printed.select("a")).union(printed.select("b")).toDF("doc_id")
    asked = stored(ids.distinct(), "copy-asked")
    sets = class_sets(docs, asked, width)
    named = members.where((F.col("same") != F.col("hub")) & fit).groupBy("same", "rep", "hub", "b").agg(F.count("*").alias("times"))
    one = F.max(F.struct("times", "hub", "b")).alias("one")
    hubbed = named.groupBy("same", "rep").agg(one).select("same", F.col("rep").alias("a"), "one.hub", "one.b")
    pairs = stored(hubbed.unionByName(printed).distinct(), "copy-pairs")
    edges = stored(hub_links(pairs, sets, least).unionByName(same_id_links(rows, classes, "same")), "copy-links")
    roots = components(edges).withColumnRenamed("node", "rep")
    rooted = stored(members.join(roots, "rep", "left").select("key", "same", "rep", "mass", F.coalesce("root", "rep").alias("root")), "copy-roots")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    across = stored(open_links(rooted.join(open_keys, "key", "left_semi"), sets, least).distinct(), "copy-links")
    roots = components(edges.unionByName(across)).withColumnRenamed("node", "rep")
    found = classes.join(roots, "rep", "left").select("same", "class_size", F.coalesce("root", "rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return join_groups(rows.select("doc_id", "same"), found, "same", "class_size").select("doc_id", own, "class_size")


def keep_one(docs: DataFrame, found=near_duplicates) -> DataFrame:
    """``docs`` with one document of each component, as ``found`` gives them: that
    with the smallest id. Rows with its id are that document and stay; of rows that
    repeat id and text one stays. Rows with a null id stay. Ids alone decide, so
    texts are shuffled only where the ids to drop are too many to broadcast."""
    named = stored(found(docs).where("doc_id is not null").select("doc_id", "component_id"), "components")
    gone = named.where("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct()
    often = named.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = whole.join(stored(gone, "gone"), "id", "left_anti")
    often = stored(often, "repeated")
    if not often.isEmpty():
        again = kept.join(often, "id").groupBy("id", "row.text").agg(F.first("row").alias("row"))
        kept = kept.join(often, "id", "left_anti").select("row").unionByName(again.select("row"))
    return kept.select("row.*")
