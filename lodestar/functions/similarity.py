"""Similarity measures (S1-S16). Everything is a Column expression but the
restricted Damerau distance, which has no built-in form and runs as one Arrow
UDF that fills the dynamic programme for all pairs of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import first, firsts_confusable, ngrams, phonetic, skeleton
from .lexicon import LEXICON, VOWELS
from .normalize import col


def bounded_levenshtein(a: Column | str, b: Column | str, k: Column | int) -> Column:
    """Null above ``k`` or if either is empty."""
    a, b = col(a), col(b)
    if isinstance(k, int):
        found = F.levenshtein(a, b, k)
    else:  # the built-in takes a literal bound
        found = F.when(k == 1, F.levenshtein(a, b, 1)).when(k == 2, F.levenshtein(a, b, 2))
    return F.when((a != "") & (b != "") & (found >= 0), found)


def _costs() -> np.ndarray:
    """Weighted substitution costs by ASCII code; 127 stands for all others."""
    cost = np.ones((128, 128))
    for a in VOWELS:
        for b in VOWELS:
            cost[ord(a), ord(b)] = 0.70
    for a, others in LEXICON.confusable.items():
        for b in others:
            cost[ord(a), ord(b)] = 0.45
    return cost


def _osa(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit and weighted distances of pairs: one pass over the cells of the
    largest table, each cell an array over the pairs."""
    rows, columns = max(map(len, a), default=0), max(map(len, b), default=0)
    x = np.array([[ord(c) for c in s] + [0] * (rows - len(s)) for s in a], np.int32).reshape(len(a), rows)
    y = np.array([[ord(c) for c in s] + [0] * (columns - len(s)) for s in b], np.int32).reshape(len(b), columns)
    la, lb, n = np.array([len(s) for s in a]), np.array([len(s) for s in b]), np.arange(len(a))
    table, out = _costs(), []
    for weighted in (False, True):
        d = np.zeros((rows + 1, columns + 1, len(a)))
        d[:, 0], d[0, :] = np.arange(rows + 1)[:, None], np.arange(columns + 1)[:, None]
        for i in range(1, rows + 1):
            p = x[:, i - 1]
            for j in range(1, columns + 1):
                q = y[:, j - 1]
                cost = np.where(p == q, 0.0, table[np.minimum(p, 127), np.minimum(q, 127)] if weighted else 1.0)
                best = np.minimum(np.minimum(d[i - 1, j] + 1, d[i, j - 1] + 1), d[i - 1, j - 1] + cost)
                if i > 1 and j > 1:
                    swap = (p == y[:, j - 2]) & (x[:, i - 2] == q)
                    best = np.where(swap, np.minimum(best, d[i - 2, j - 2] + (0.55 if weighted else 1.0)), best)
                d[i, j] = best
        out.append(d[la, lb, n])
    same = np.array([s == t for s, t in zip(a, b, strict=True)], bool)
    return np.where(same, 0, out[0]), np.where(same, 0, out[1])


_PAIR = T.StructType([T.StructField("raw", T.IntegerType()), T.StructField("weighted", T.DoubleType())])


@F.pandas_udf(_PAIR)
def osa(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """S2, S3. Pairs are grouped by size, so one long string doesn't widen the
    table of all others."""
    left, right = a.fillna(""), b.fillna("")
    size = np.maximum(left.str.len(), right.str.len()) // 8
    raw, weighted = np.zeros(len(a)), np.zeros(len(a))
    for s in np.unique(size):
        every = np.flatnonzero(size == s)
        for part in np.array_split(every, -(-len(every) * (8 * int(s) + 8) ** 2 // 4_000_000) or 1):
            raw[part], weighted[part] = _osa(left.iloc[part].tolist(), right.iloc[part].tolist())
    return pd.DataFrame({"raw": raw.astype(np.int32), "weighted": weighted})


def longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def shortest(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b))


def _of_both(a: Column, b: Column, value: Column) -> Column:
    return F.when((a != "") & (b != ""), value).otherwise(F.lit(0.0))


def edit_similarity(distance: Column | str, a: Column | str, b: Column | str) -> Column:
    """S4."""
    a, b = col(a), col(b)
    return _of_both(a, b, F.greatest(F.lit(0.0), 1 - col(distance) / longest(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    """S5, of two arrays of distinct elements."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def _places(a: Column, b: Column, hit) -> Column:
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(shortest(a, b), F.lit(1))), hit))


def prefix_score(a: Column | str, b: Column | str) -> Column:
    """A prefix of length i is shared exactly for i up to the first mismatch."""
    a, b = col(a), col(b)
    return _of_both(a, b, _places(a, b, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)) / longest(a, b))


def suffix_score(a: Column | str, b: Column | str) -> Column:
    """S7."""
    return prefix_score(F.reverse(col(a)), F.reverse(col(b)))


def position_score(a: Column | str, b: Column | str) -> Column:
    """S10."""
    a, b = col(a), col(b)
    return _of_both(a, b, _places(a, b, lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) / longest(a, b))


def coverage(a: Column | str, b: Column | str) -> Column:
    """S11."""
    a, b = col(a), col(b)
    return _of_both(a, b, shortest(a, b) / longest(a, b))


def subsequence_score(q: Column | str, t: Column | str) -> Column:
    """0 unless every character of ``q`` follows in ``t``, earliest places taken."""
    q, t = col(q), col(t)
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(state: Column, i: Column) -> Column:
        # The end is -1 once a character was not found.
        found = F.when(state["end"] >= 0, F.call_function("locate", F.substr(q, i, F.lit(1)), t, state["end"] + 1)).otherwise(F.lit(0))
        return F.struct(F.when(state["start"] == 0, found).otherwise(state["start"]).alias("start"), F.when(found > 0, found).otherwise(F.lit(-1)).alias("end"))

    met = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), begin, step)
    value = F.least(F.lit(1.0), 0.6 * (F.length(q) / (met["end"] - met["start"] + 1)) + 0.4 * (F.length(q) / F.length(t)))
    return F.when((q != "") & (t != "") & (F.length(q) <= F.length(t)) & (met["end"] > 0), value).otherwise(F.lit(0.0))


def key_similarity(q: Column | str, t: Column | str) -> Column:
    """S9."""
    q, t = col(q), col(t)
    return _of_both(q, t, F.when(q == t, F.lit(1.0)).when(t.startswith(q) | q.startswith(t), shortest(q, t) / longest(q, t)).otherwise(0.75 * subsequence_score(q, t)))


def partial_prefix(q: Column | str, t: Column | str) -> Column:
    """S14."""
    q, t = col(q), col(t)
    return (q != "") & (t != "") & (F.abs(F.length(q) - F.length(t)) >= 2) & (t.startswith(q) | q.startswith(t)) & (shortest(q, t) / longest(q, t) < 0.86)


def pure_deletion(q: Column | str, bc: Column | str, raw: Column | str) -> Column:
    """S13; S12 holds where S8 is positive."""
    q, bc, raw = col(q), col(bc), col(raw)
    return (F.length(q) >= 5) & (raw <= 2) & (F.length(bc) - F.length(q) == raw) & (subsequence_score(q, bc) > 0)


RESCUE_WEIGHTS = (("edit", 0.58), ("weighted", 0.52), ("prefix", 0.16), ("suffix", 0.10), ("grams", 0.18), ("skeleton", 0.16), ("phonetic", 0.14), ("subsequence", 0.10), ("positional", 0.24), ("coverage", 0.16))


def rescue_parts(q: Column | str, bc: Column | str, raw: Column | str, weighted: Column | str) -> dict[str, Column]:
    """The measures that S15 blends."""
    q, bc = col(q), col(bc)
    return {
        "edit": edit_similarity(raw, q, bc), "weighted": edit_similarity(weighted, q, bc), "prefix": prefix_score(q, bc), "suffix": suffix_score(q, bc),
        "grams": jaccard(ngrams(q, 3), ngrams(bc, 3)), "skeleton": key_similarity(skeleton(q), skeleton(bc)), "phonetic": key_similarity(phonetic(q), phonetic(bc)),
        "subsequence": subsequence_score(q, bc), "positional": position_score(q, bc), "coverage": coverage(q, bc),
    }


def rescue_allowed(q: Column | str, bc: Column | str) -> Column:
    """Pairs to which S15 gives a score at all."""
    q, bc = col(q), col(bc)
    return (q != "") & (bc != "") & F.length(q).between(4, 18) & (F.length(bc) <= 24) & ((F.abs(F.length(q) - F.length(bc)) <= 5) | bc.startswith(F.substring(q, 1, 4)))


def rescue_score(q: Column | str, bc: Column | str, m) -> Column:
    """S15 from its parts ``m[name]``."""
    q, bc = col(q), col(bc)
    gap = F.abs(F.length(q) - F.length(bc))
    nearest = F.greatest(m["edit"], m["weighted"])
    total = F.lit(0.0)
    for name, weight in RESCUE_WEIGHTS:
        total = total + weight * m[name]
    none = F.lit(0.0)
    total = total + F.when(first(q) == first(bc), 0.12).when(firsts_confusable(q, bc), 0.06).otherwise(none)
    total = total + F.when((gap <= 1) & (m["weighted"] >= 0.76), 0.18).otherwise(none)
    total = total + F.when((m["prefix"] >= 0.55) & (m["weighted"] >= 0.66), 0.08).otherwise(none)
    total = total + F.when((m["weighted"] >= 0.84) & (m["positional"] >= 0.70), 0.22).otherwise(none)
    total = total - F.when(partial_prefix(q, bc) & (m["weighted"] < 0.84), 0.18 + F.least(F.lit(0.24), 0.05 * gap)).otherwise(none)
    total = total - F.when((nearest < 0.58) & (F.greatest(m["skeleton"], m["phonetic"]) < 0.72), 0.20).otherwise(none)
    return total - F.when((m["prefix"] < 0.30) & (m["grams"] < 0.12) & (nearest < 0.70), 0.10).otherwise(none)
