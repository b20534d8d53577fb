"""Text normalisation and tokens (N1-N14), as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ARABIC_FROM, ARABIC_TO, DIACRITICS, LEXICON, UNIT_SUFFIX


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_in(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def filled(*columns: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.when(col(c) != "", col(c)) for c in columns], F.lit(""))


def norm(c: Column | str) -> Column:
    """Digits and letter variants mapped, diacritics deleted, upper case,
    every other run of characters one blank; '' for null."""
    text = F.regexp_replace(F.translate(F.coalesce(col(c).cast("string"), F.lit("")), ARABIC_FROM, ARABIC_TO), DIACRITICS, "")
    return F.trim(F.regexp_replace(F.upper(text), "[^0-9A-Z؀-ۿ]+", " "))


def squeeze(normed: Column | str) -> Column:
    """A normalised text without blanks."""
    return F.replace(col(normed), F.lit(" "), F.lit(""))


def compact(c: Column | str) -> Column:
    """N2."""
    return squeeze(norm(c))


def pieces(normed: Column | str) -> Column:
    """Words of a normalised text; none for ''."""
    return F.filter(F.split(col(normed), " "), lambda t: t != "")


def tokens(normed: Column | str) -> Column:
    """Words of two characters or more that are no noise; repeats stay."""
    return F.filter(pieces(normed), lambda t: (F.length(t) >= 2) & ~F.array_contains(words_in(LEXICON.noise), t))


def numbers(normed: Column | str) -> Column:
    """Distinct digit runs that no ASCII letter, digit or underscore adjoins."""
    return F.array_distinct(F.regexp_extract_all(col(normed), F.lit("(?<![0-9A-Za-z_])([0-9]+)(?![0-9A-Za-z_])"), F.lit(1)))


def route_hints(normed: Column | str) -> Column:
    """Distinct routes that words name, noise words included."""
    table = mapping(LEXICON.routes)
    return F.array_distinct(F.filter(F.transform(pieces(normed), lambda t: F.try_element_at(table, t)), lambda r: r.isNotNull()))


def is_unit(t: Column) -> Column:
    return F.array_contains(words_in(LEXICON.context_noise), t)


def context_tokens(normed: Column | str) -> Column:
    """Words without units, forms and the numbers beside them; all words if
    nothing is left, or if there are fewer than two."""
    every = pieces(normed)

    def keep(t: Column, i: Column) -> Column:
        before, after = F.coalesce(F.get(every, i - 1), F.lit("")), F.coalesce(F.get(every, i + 1), F.lit(""))
        beside = is_unit(before) | is_unit(after) | after.rlike(UNIT_SUFFIX)
        return ~(is_unit(t) | t.rlike(UNIT_SUFFIX) | (t.rlike("^[0-9]+$") & (i > 0) & beside))

    cleaned = F.filter(every, keep)
    return F.when((F.size(every) < 2) | (F.size(cleaned) == 0), every).otherwise(cleaned)


def brand_compacts(normed: Column | str) -> Column:
    """Distinct context tokens that can be brands."""
    skip = words_in((*LEXICON.generic, *LEXICON.context_noise))
    return F.array_distinct(F.filter(context_tokens(normed), lambda t: ~F.array_contains(skip, t) & (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.rlike(UNIT_SUFFIX)))


def is_generic(t: Column) -> Column:
    return F.array_contains(words_in(LEXICON.generic), t)


def brand_head(normed: Column | str) -> Column:
    """First word of three characters or more that isn't generic, else the first."""
    every = pieces(normed)
    return F.coalesce(F.get(F.filter(every, lambda t: (F.length(t) >= 3) & ~is_generic(t)), F.lit(0)), F.get(every, F.lit(0)), F.lit(""))


def family_key(normed: Column | str, head: Column | str | None = None) -> Column:
    """The normalised head where there is one, else the text without
    qualifiers at its end."""
    bare = F.regexp_replace(col(normed), f"( ({'|'.join(LEXICON.qualifiers)}))+$", "")
    return bare if head is None else F.when(col(head) != "", norm(head)).otherwise(bare)


def brand_like(raw_norm: Column | str, n_tokens: Column) -> Column:
    """4 to 20 characters, at most three tokens, no unit or form word."""
    size = F.length(squeeze(raw_norm))
    return size.between(4, 20) & (n_tokens <= 3) & ~F.exists(pieces(raw_norm), lambda t: is_unit(t) | t.rlike(UNIT_SUFFIX))


def generic_tokens(found: Column | str) -> Column:
    return F.filter(col(found), is_generic)


def specific_tokens(found: Column | str) -> Column:
    """The tokens that aren't generic."""
    return F.filter(col(found), lambda t: ~is_generic(t))


def warning_list(c: Column | str) -> Column:
    """Flags between bars or semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[|;]"), lambda w: F.trim(w)), lambda w: w != "")


def alias_target(*keys: Column | str) -> Column:
    """The base that the first known key stands for, else ''."""
    table = mapping(LEXICON.aliases)
    return F.coalesce(*[F.try_element_at(table, col(k)) for k in keys], F.lit(""))


def meets_alias(bn: Column | str, bc: Column | str, target: Column) -> Column:
    """The base is the target, or begins with it. Targets are single words."""
    return (target != "") & ((col(bn) == target) | col(bn).startswith(F.concat(target, F.lit(" "))) | col(bc).startswith(target))
