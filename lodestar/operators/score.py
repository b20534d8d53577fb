"""Additive scoring (SC1-SC44, S15, S16, F1-F3): an array of (signal, points)
for each pair of a query and a record. Points add up in the published order; a
signal that is awarded twice counts twice and is named once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import first, firsts_confusable, keyboard_ratio
from ..functions.normalize import alias_target, is_generic, meets_alias
from ..functions.similarity import bounded_levenshtein, coverage, osa, position_score, prefix_score, rescue_allowed, rescue_parts, rescue_score, suffix_score

RESCUE_LEAST = 0.88
FLAGS = (("weighted", 0.76, "algorithm4_weighted_confusion_edit"), ("positional", 0.68, "algorithm4_position_overlap"), ("phonetic", 0.78, "algorithm4_phonetic_family"), ("skeleton", 0.80, "algorithm4_skeleton_family"))
EMPTY = "cast(array() as array<struct<signal:string,pts:double>>)"


def award(signal: str | Column, points, when: Column | None = None) -> Column:
    s = F.struct((F.lit(signal) if isinstance(signal, str) else signal).alias("signal"), (points if isinstance(points, Column) else F.lit(float(points))).cast("double").alias("pts"))
    return s if when is None else F.when(F.coalesce(when, F.lit(False)), s)


def awards(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _has_word(text: str, t: Column) -> Column:
    return F.array_contains(F.split(F.col(text), " "), t)


def exact_and_prefix() -> Column:
    """SC1-SC15."""
    c, qn, qc = F.col, F.col("qn"), F.col("qc")
    long_n, long_c = F.length(qn) >= 2, F.length(qc) >= 3
    n18, c18 = F.least(F.length(qn), F.lit(18)), F.least(F.length(qc), F.lit(18))
    return awards(
        award("exact_name", 1200, c("nn") == qn), award("exact_compact", 1160, c("c") == qc), award("exact_arabic_alias", 1120, (c("arn") == qn) | (c("arc") == qc)),
        award("exact_base_group", 980, (c("bn") == qn) | (c("bc") == qc)), award("exact_ingredient", 720, (c("ingn") == qn) | (c("ingc") == qc)),
        award("heard_spelling_alias", 1700, meets_alias("bn", "bc", alias_target("qc", "qn"))),
        award("prefix_name", 420 + n18, long_n & c("nn").startswith(qn)), award("prefix_arabic", 410 + n18, long_n & c("arn").startswith(qn)),
        award("prefix_base", 390 + n18, long_n & c("bn").startswith(qn)), award("prefix_ingredient", 260, long_n & c("ingn").startswith(qn)),
        award("prefix_compact", 380 + c18, long_c & c("c").startswith(qc)), award("prefix_base_compact", 390 + c18, long_c & c("bc").startswith(qc)),
        award("prefix_arabic_compact", 390 + c18, long_c & c("arc").startswith(qc)), award("contains_compact", 180, long_c & c("c").contains(qc)),
        award("query_contains_base", 360, long_c & (F.length("bc") >= 4) & qc.contains(c("bc"))),
    )


def token_signal(t: Column) -> Column:
    """SC16-SC23 for one token: the first that applies; ``hit`` where it counts."""
    specific, c = ~is_generic(t), F.col
    long4 = specific & (F.length(t) >= 4)
    t18 = F.least(F.length(t), F.lit(18))

    def give(signal: str, points, hit: bool) -> Column:
        return F.struct(F.lit(signal).alias("signal"), (points if isinstance(points, Column) else F.lit(float(points))).cast("double").alias("pts"), F.lit(hit).alias("hit"))

    return (
        F.when(meets_alias("bn", "bc", alias_target(t)), give("heard_spelling_alias", 1700, True))
        .when(specific & (_has_word("bn", t) | (c("bc") == t)), give("token_base", 210, True))
        .when(long4 & c("bc").startswith(t), give("context_clean_prefix_base", 460 + t18, True))
        .when(long4 & c("bc").contains(t), give("context_clean_contains_base", 260, True))
        .when(t.rlike("^[0-9]+$") & c("arc").startswith(t), give("token_exact_arabic_alias", 940, True))
        .when(_has_word("nn", t) | _has_word("arn", t), give("token_name", 140, True))
        .when(_has_word("ingn", t), give("token_ingredient", 80, False))
        .when(specific & (F.length(t) >= 3) & c("text_norm").contains(t), give("token_contains", 42, False))
    )


def token_awards() -> Column:
    """SC16-SC24."""
    found = F.array_compact(F.transform("q_tokens", token_signal))
    hits = F.size(F.filter(found, lambda s: s["hit"]))
    return F.concat(F.transform(found, lambda s: F.struct(s["signal"].alias("signal"), s["pts"].alias("pts"))), awards(award("multi_token_match", 160.0 * hits, hits >= 2)))


def context_awards() -> Column:
    """SC27."""
    c = F.col
    specific = F.exists("q_specific", lambda t: _has_word("arn", t) | _has_word("nn", t) | _has_word("bn", t) | (c("arc") == t) | c("c").contains(t) | c("bc").contains(t))
    generic = F.exists("q_generic", lambda t: _has_word("nn", t) | _has_word("bn", t) | c("c").contains(t) | c("bc").contains(t))
    return awards(award("generic_context_match", 560, specific & generic))


def fuzzy_awards() -> Column:
    """SC25, SC26, unit by unit."""

    def unit(u: Column) -> Column:
        d = bounded_levenshtein(u["value"], "bc", u["threshold"])
        close = award(F.concat(F.lit("fuzzy_base_ed"), d.cast("string")), 250 - 60 * d, (F.length(u["value"]) <= 32) & d.isNotNull())
        return awards(close, award("phonetic_skeleton", 170, (F.length(u["skeleton"]) >= 3) & (u["skeleton"] == F.col("sk"))))

    return F.flatten(F.transform("q_units", unit))


def key_awards() -> Column:
    """SC28-SC32, SC34, SC35: they depend on the base alone."""
    c = F.col
    sound = (F.length("q_ph") >= 3) & (c("ph") != "")
    single = (F.size("q_tokens") == 1) & (F.length("qc") >= 4) & c("head_family") & c("bn").contains(" ")
    share, d = coverage("qc", "headc"), bounded_levenshtein("qc", "headc", 2)
    typed = keyboard_ratio("qc", "bc")
    same_first = (first("bc") != "") & (first("qc") == first("bc"))
    return awards(
        award("drug_phonetic_key", 500, sound & (c("q_ph") == c("ph"))), award("drug_phonetic_prefix", 650, sound & (c("q_ph") != c("ph")) & c("ph").startswith(c("q_ph"))),
        award("phonetic_first_char", 250, sound & same_first),
        award("brand_head_consonant_frame", 1200.0 * share, single & (F.length("q_sk") >= 3) & (c("q_sk") == c("headsk")) & (share >= 0.60)),
        award(F.concat(F.lit("brand_head_ed"), d.cast("string")), 400 - 60 * d, single & d.isNotNull() & ((first("qc") == first("headc")) | firsts_confusable("qc", "headc"))),
        award("keyboard_proximity", 250.0 * typed, typed >= 0.68), award("keyboard_first_char", 160, (typed >= 0.68) & same_first),
    )


def visual_awards() -> Column:
    """SC33."""
    return awards(award("visual_confusion_candidate", 210, F.exists("q_visual", lambda v: (F.col("bc") == v) | F.col("bc").startswith(v) | F.col("c").startswith(v))))


def rescue_awards() -> Column:
    """SC36 and the labels SC37, from the column ``rescue`` of ``evidence``."""
    met = F.col("rescue.score") >= RESCUE_LEAST
    return awards(award("algorithm4_family_rescue", 620.0 * F.col("rescue.score"), met), *[award(label, 0, met & (F.col(f"rescue.{part}") >= least)) for part, least, label in FLAGS])


def context_facts() -> Column:
    """SC38-SC44."""
    c, has = F.col, lambda flag: F.array_contains("warning_flags", flag)
    met = F.arrays_overlap("q_routes", "route_hints")
    asked = F.size("q_routes") > 0
    return awards(
        award("number_match", 52, F.arrays_overlap("q_numbers", "nums")), award("form_route_match", 58, asked & met),
        award("form_route_mismatch", -16, asked & ~F.coalesce(met, F.lit(False)) & ~F.coalesce(c("route_family"), F.lit("")).isin("", "unknown")),
        award("quality_status_penalty", -8, has("UNKNOWN_ROUTE")), award("quality_status_penalty", -6, has("MISSING_COMPOSITION")),
        award("quality_status_penalty", -28, has("N/A") | has("CANCELLED") | has("ILLEGAL_IMPORT")),
        award("generic_dominance_penalty", -420, (F.size("q_specific") > 0) & is_generic(c("bc"))),
    )


#: What evidence depends on: a query's fields and a base's.
GRAIN = "query_id qc q_values q_units q_ph q_sk q_tokens bn bc headc head_family sk ph headsk".split()
BASE = ["query_id", "bn", "headc", "head_family"]


def evidence(pairs: DataFrame) -> DataFrame:
    """BASE with raw, weighted, head_raw, the best rescue, and the awards of the
    base: the costly measures once for each distinct (query, base), not once a
    record."""
    grain = pairs.select(*GRAIN).distinct().withColumn("base_awards", F.concat(fuzzy_awards(), key_awards()))
    value = grain.select(*BASE, "qc", "bc", "base_awards", F.posexplode("q_values").alias("at", "value"))
    value = value.withColumn("d", osa("value", "bc"))
    head = F.when(F.col("at") == 0, osa("qc", "headc"))
    value = value.withColumns({"head_raw": head["raw"], "m": F.struct(*[v.alias(k) for k, v in rescue_parts("value", "bc", F.col("d.raw"), F.col("d.weighted")).items()])})
    score = F.when(rescue_allowed("value", "bc"), rescue_score("value", "bc", F.col("m")))
    value = value.withColumn("rescue", F.when(score.isNotNull(), F.struct(score.alias("score"), *[F.col(f"m.{p}").alias(p) for p, _, _ in FLAGS])))
    own = F.col("at") == 0
    order = F.when(F.col("rescue").isNotNull(), F.struct(F.col("rescue.score"), -F.col("at")))
    return value.groupBy(*BASE).agg(
        F.max(F.when(own, F.col("d.raw"))).alias("raw"), F.max(F.when(own, F.col("d.weighted"))).alias("weighted"), F.max("head_raw").alias("head_raw"), F.max_by("rescue", order).alias("rescue"), F.first("base_awards").alias("base_awards")
    )


def pattern_matches(target: Column | str = "bc", visible: Column | str = "qc", ending: Column | str = "q_ending", mode: Column | str = "unreadable_mode") -> Column:
    """F1."""
    t, v, e, m = (F.col(x) if isinstance(x, str) else x for x in (target, visible, ending, mode))
    after = t.startswith(v) & (F.length(t) > F.length(v))
    before = t.endswith(v) & (F.length(t) > F.length(v))
    middle = (v != "") & (e != "") & t.startswith(v) & t.endswith(e) & (F.length(t) > F.length(v) + F.length(e))
    return F.when((t == "") | (m == "none"), True).when(m == "after", after).when(m == "before", before).when(m == "middle", middle).otherwise(True)


SCORED = (
    "query_id qc qn q_tokens q_numbers q_generic q_specific unreadable_mode ending_fragment result_limit brand_like candidate_id commercial_name_en commercial_name_ar base_group_key "
    "scientific_name ingredient_key route_family price_egp manufacturer drug_class base_variant_count base_route_count base_ingredient_count bc bn base_norm family_group_key warning_flags"
).split()


def score(pairs: DataFrame) -> DataFrame:
    """Scored pairs with evidence fields; only scores above 0 stay (F2), and in
    the unreadable modes only bases that fit the pattern (F3)."""
    rows = pairs.join(evidence(pairs), BASE)
    parts = F.concat(exact_and_prefix(), token_awards(), context_awards(), F.col("base_awards"), visual_awards(), rescue_awards(), context_facts())
    rows = rows.withColumn("awards", parts).withColumn("score", F.aggregate("awards", F.lit(0.0), lambda a, s: a + s["pts"]))
    rows = rows.where(F.col("score") > 0).where(pattern_matches())
    known = F.col("unreadable_mode") != "none"
    signals = F.array_distinct(F.transform("awards", lambda s: s["signal"]))
    return rows.select(
        *SCORED, (F.col("score") + F.when(known, 1800.0).otherwise(0.0)).alias("score"),
        F.array_sort(F.when(known, F.array_append(signals, F.concat(F.lit("known_unreadable_"), F.col("unreadable_mode")))).otherwise(signals)).alias("signals"),
        "raw", "weighted", "head_raw", (F.col("q_sk") == F.col("headsk")).alias("head_frame"), (F.col("head_family") & F.col("bn").contains(" ")).alias("head_variant"),
        position_score("qc", "bc").alias("positional"), F.greatest(prefix_score("qc", "bc"), suffix_score("qc", "bc")).alias("edge"),
    )
