"""Phonetic, visual and keyboard keys (K1-K9), as Column expressions. All but
``visual_variants`` take keys that are compact already."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import LEXICON, VOWELS
from .normalize import col, mapping

NOTHING = "cast(array() as array<string>)"


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def skeleton(c: Column | str) -> Column:
    """K1: consonant frame."""
    return _chain(col(c), ("PH", "F"), ("[CQK]", "K"), ("[PV]", "B"), ("[SZ]", "S"), (f"[{VOWELS}]", ""), (r"(.)\1+", "$1"))


def phonetic(c: Column | str) -> Column:
    """K2: J becomes G only after G has become K, so the two stay apart."""
    return _chain(
        col(c), ("PH", "F"), ("CK", "K"), ("GH", "G"), ("[BPFV]", "P"), ("[DT]", "T"), ("[CGKQ]", "K"), ("[SZ]", "S"), ("J", "G"), (f"[{VOWELS}]", ""), (r"(.)\1+", "$1")
    )


def ngrams(c: Column | str, n: int) -> Column:
    """K3: distinct n-grams."""
    c = col(c)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(every)).otherwise(F.expr(NOTHING))


def _drop_one(c: Column) -> Column:
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.length(c))))
    return F.when(F.length(c) > 0, one).otherwise(F.expr(NOTHING))


def deletes(c: Column | str, k: Column | int) -> Column:
    """K4: all strings by at most ``k`` (0, 1 or 2) deletions, the key included."""
    c, k = col(c), F.lit(k) if isinstance(k, int) else k
    one = F.when(k >= 1, _drop_one(c)).otherwise(F.expr(NOTHING))
    two = F.when(k >= 2, F.flatten(F.transform(_drop_one(c), _drop_one))).otherwise(F.expr(NOTHING))
    return F.array_distinct(F.concat(F.array(c), one, two))


def max_deletes(c: Column | str) -> Column:
    """K5."""
    n = F.length(col(c))
    return F.when(n < 4, 0).when(n <= 7, 1).otherwise(2)


def visual_variants(c: Column | str) -> Column:
    """K6: the key with one look-alike pair replaced throughout."""
    c = col(c)
    made = F.array_compact(F.array(*[F.when(c.contains(a), F.replace(c, F.lit(a), F.lit(b))) for a, b in LEXICON.lookalikes]))
    return F.when(F.length(c) >= 3, F.array_remove(F.array_distinct(made), c)).otherwise(F.expr(NOTHING))


def first(c: Column | str) -> Column:
    return F.substring(col(c), 1, 1)


def confusable_with(letter: Column | str) -> Column:
    """The letters confusable with a letter, as a string."""
    return F.coalesce(F.try_element_at(mapping(LEXICON.confusable), col(letter)), F.lit(""))


def firsts_confusable(a: Column | str, b: Column | str) -> Column:
    """K7."""
    return (first(b) != "") & confusable_with(first(a)).contains(first(b))


def first_letter_variants(c: Column | str) -> Column:
    """K7: the key with its first letter replaced by each confusable one."""
    c = col(c)
    letters = confusable_with(first(c))
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters), F.lit(1))), lambda i: F.concat(F.substr(letters, i, F.lit(1)), F.substr(c, F.lit(2), F.length(c))))
    return F.when(F.length(letters) > 0, made).otherwise(F.expr(NOTHING))


def keyboard_ratio(q: Column | str, t: Column | str) -> Column:
    """K8: share of places where the typed key is the target's or beside it."""
    q, t, near = col(q), col(t), mapping(LEXICON.neighbours)

    def hit(i: Column) -> Column:
        a, b = F.substr(q, i, F.lit(1)), F.substr(t, i, F.lit(1))
        return (a == b) | F.coalesce(F.try_element_at(near, b).contains(a), F.lit(False))

    n = F.length(q)
    hits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), hit))
    return F.when((n == F.length(t)) & n.between(4, 18), hits / n).otherwise(F.lit(0.0))


def prefixes(c: Column | str, least: int, most: int) -> Column:
    """Leading parts of ``least`` to ``most`` characters."""
    c = col(c)
    made = F.transform(F.sequence(F.lit(least), F.greatest(F.least(F.lit(most), F.length(c)), F.lit(least))), lambda n: F.substr(c, F.lit(1), n))
    return F.when(F.length(c) >= least, made).otherwise(F.expr(NOTHING))


def suffix_keys(c: Column | str) -> Column:
    """K9: trailing parts of 3 to 12 characters, reversed."""
    return prefixes(F.reverse(col(c)), 3, 12)
