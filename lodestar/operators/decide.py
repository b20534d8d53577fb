"""Decisions (D1-D7, A5-A9): risk, clarification, decision type, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.keys import first
from ..functions.lexicon import ROUTE_LABELS, WARNING_LABELS
from ..functions.normalize import filled, mapping

STRONG = ("heard_spelling_alias", "exact_name", "exact_compact", "exact_arabic_alias", "exact_base_group")
WEAK = ("contains_compact", "query_contains_base", "keyboard_proximity", "visual_confusion_candidate", "drug_phonetic_key", "phonetic_skeleton")


def _any(signals: Column | str, names) -> Column:
    return F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names]))


def strong(signals: Column | str = "signals") -> Column:
    """D1."""
    return _any(signals, STRONG)


def approximate_only(signals: Column | str = "signals") -> Column:
    """Approximate evidence and nothing exact."""
    fuzzy = F.exists(signals, lambda s: s.startswith("fuzzy_") | s.contains("phonetic") | s.isin("keyboard_proximity", "visual_confusion_candidate"))
    return fuzzy & ~F.exists(signals, lambda s: s.startswith("exact_") | s.startswith("prefix_") | (s == "heard_spelling_alias"))


def risk(queries: DataFrame, danger: DataFrame, registry: DataFrame) -> DataFrame:
    """query_id, risk counts, force and exact_short. Prefix sets
    are nested, so the first letter's counts are the largest."""
    rows = queries.select("query_id", "qc", first("qc").alias("prefix")).join(danger, "prefix", "left")
    short = registry.select(F.col("key").alias("qc"), F.lit(True).alias("listed"))
    rows = rows.join(short, "qc", "left")
    counts = {k: F.coalesce(k, F.lit(0)) for k in ("bases", "products", "ingredients", "routes")}
    rows = rows.withColumns(counts).withColumn("exact_short", (F.length("qc") <= 4) & F.coalesce("listed", F.lit(False)))
    n = F.length("qc")
    force = ((n <= 2) & (F.col("bases") > 1)) | ((n <= 4) & ((F.col("bases") >= 4) | (F.col("ingredients") >= 3))) | (F.col("bases") >= 12) | (F.col("ingredients") >= 6)
    return rows.select("query_id", *counts, "exact_short", (~F.col("exact_short") & force).alias("force"))


def clarify(ranked: DataFrame, risks: DataFrame) -> DataFrame:
    """A6, D2, D3."""
    every = W.Window.partitionBy("query_id")
    top = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(every)
    ing = filled("ingredient_key", "scientific_name")
    distinct = lambda c, when: F.size(F.collect_set(F.when(when & (c != ""), c)).over(every))
    rows = ranked.withColumn("top_score", top)
    rows = rows.withColumns({
        "close_bases": distinct(F.coalesce("base_group_key", F.lit("")), (F.col("rank") <= 8) & (F.col("score") >= F.col("top_score") - 45)),
        "close_ingredients": distinct(ing, (F.col("rank") <= 5) & (F.col("score") >= F.col("top_score") - 90)),
    }).join(risks, "query_id")
    n, numbered = F.length("qc"), F.size("q_numbers") > 0
    exact, solid, short = _any("signals", ("exact_name", "exact_compact")), strong(), F.col("exact_short")
    more = lambda c: F.coalesce(F.col(c) > 1, F.lit(False))
    needs = (
        ((n <= 2) & ~short) | ((n <= 4) & ~short & ~numbered & ~exact) | (short & (F.col("bases") >= 8) & (F.col("ingredients") >= 4) & ~exact) | F.col("force")
        | ((F.size("q_tokens") > 0) & (F.size("q_specific") == 0) & (F.size("q_generic") > 0)) | ((F.col("close_ingredients") > 1) & ~exact & ~solid)
        | (more("base_variant_count") & ~numbered & ~exact) | more("base_route_count") | (more("base_ingredient_count") & ~exact) | (F.col("close_bases") > 1)
        | approximate_only() | (~solid & _any("signals", WEAK)) | (F.col("unreadable_mode") != "none") | (F.size("warning_flags") > 0)
    )
    return rows.withColumn("needs_clarification", needs)


def project(rows: DataFrame) -> DataFrame:
    """The 19 result columns, keyed by query_id."""
    dash = lambda *c: F.when(filled(*c) != "", filled(*c)).otherwise(F.lit("-"))
    return rows.select(
        "query_id", "rank", "candidate_id", "commercial_name_en", "commercial_name_ar", dash("base_group_key").alias("base_group_key"), dash("ingredient_key", "scientific_name").alias("ingredient_key"),
        dash("route_family").alias("route_family"), "price_egp", dash("manufacturer").alias("manufacturer"), dash("drug_class").alias("drug_class"), F.round("score").cast("long").alias("score"),
        F.col("raw").alias("raw_edit_distance"), F.round("weighted", 3).alias("weighted_edit_distance"), F.round("positional", 3).alias("positional_evidence"), F.round("edge", 3).alias("edge_evidence"),
        "family_group_key", F.array_join("signals", "|").alias("matched_signals"), F.array_join("warning_flags", "|").alias("warnings"), "needs_clarification",
    )


def summarize(queries: DataFrame, results: DataFrame, risks: DataFrame, counts: DataFrame) -> DataFrame:
    """SNK1, D4: a row for each query; queries without results included."""
    firsts = results.where("rank <= 2").groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == r, F.struct("raw_edit_distance", "base_group_key", "family_group_key"))).alias(f"r{r}") for r in (1, 2)])
    rows = results.join(firsts, "query_id").groupBy("query_id").agg(
        F.bool_or("needs_clarification").alias("clarify"), F.countDistinct(F.when(F.col("rank") <= 8, F.col("family_group_key"))).alias("families"),
        F.bool_or((F.col("family_group_key") == F.col("r1.family_group_key")) & (F.col("base_group_key") != F.col("r1.base_group_key"))).alias("variants"),
        F.bool_or((F.col("r1.raw_edit_distance") == F.col("r2.raw_edit_distance")) & (F.col("r1.base_group_key") != F.col("r2.base_group_key"))).alias("equal"),
    )
    out = queries.join(rows, "query_id", "left").join(risks, "query_id").join(counts, "query_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (
        F.when(F.col("unreadable_mode") != "none", F.concat(F.lit("unreadable_"), "unreadable_mode", F.lit("_matches"))).when(yes("variants"), "family_variant_selection").when(yes("equal"), "equal_distance_ambiguity")
        .when((F.col("families") > 1) & yes("clarify"), "collision_ambiguity").when(yes("clarify"), "possible_matches").otherwise("ranked_matches")
    )
    danger = F.struct(F.col("bases").alias("base_count"), F.col("products").alias("product_count"), F.col("ingredients").alias("ingredient_count"), F.col("routes").alias("route_count"), "force")
    return out.select("query_id", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), yes("clarify").alias("needs_clarification"), kind.alias("decision_type"), "unreadable_mode", "ending_fragment", danger.alias("prefix_risk"))


def warning_label(flag: Column) -> Column:
    """D6."""
    return F.coalesce(F.try_element_at(mapping(WARNING_LABELS), flag), F.initcap(F.lower(F.replace(flag, F.lit("_"), F.lit(" ")))))


def route_label(route: Column) -> Column:
    """D6."""
    return F.coalesce(F.try_element_at(mapping(ROUTE_LABELS), route), F.replace(route, F.lit("_"), F.lit(" ")))


def escape_html(text: Column) -> Column:
    """D7."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def summary_message(decision: Column, query: Column, ending: Column) -> Column:
    """One sentence for a decision, in our own words."""
    quoted = F.concat(F.lit('"'), query, F.lit('"'))
    return (
        F.when(decision == "unreadable_after_matches", F.concat(F.lit("Names that go on after "), quoted)).when(decision == "unreadable_before_matches", F.concat(F.lit("Names that end in "), quoted))
        .when(decision == "unreadable_middle_matches", F.concat(F.lit("Names from "), quoted, F.lit(' to "'), ending, F.lit('"'))).when(decision == "family_variant_selection", F.concat(F.lit("Pick a variant of "), quoted))
        .when(decision == "equal_distance_ambiguity", F.concat(F.lit("Names spelled equally near to "), quoted)).when(decision == "collision_ambiguity", F.concat(F.lit("Several families fit "), quoted))
        .when(decision == "ranked_matches", F.concat(F.lit("Results for "), quoted)).otherwise(F.concat(F.lit("Results to confirm for "), quoted))
    )
