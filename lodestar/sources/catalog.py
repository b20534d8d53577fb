"""Catalogue sources and preparation: readers, derived fields, statistics and
catalogue-quality operators (SRC1-SRC4, A1-A3, A7, P1-P8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import phonetic, skeleton
from ..functions.normalize import brand_head, col, compact, family_key, filled, norm, numbers, pieces, route_hints, squeeze, warning_list

#: The canonical columns and the short keys that JSON catalogues use for them.
FIELDS = {
    "candidate_id": "id", "commercial_name_en": "n", "commercial_name_en_norm": "nn", "commercial_name_en_compact": "c", "commercial_name_ar": "ar", "commercial_name_ar_norm": "arn",
    "base_group_key": "b", "strengths_join": "st", "packages_join": None, "detected_form_from_name": "f", "route": None, "route_family": "r", "scientific_name": "s", "ingredient_key": "ing",
    "ingredient_count": None, "manufacturer": "m", "manufacturer_primary": None, "manufacturer_parent": None, "drug_class": "dc", "drug_class_top": None, "price_egp": "p", "needs_review": None,
    "review_reasons": "w", "base_variant_count": "bv", "base_route_count": "br", "base_ingredient_count": "bi",
}
TYPES = {"ingredient_count": "int", "price_egp": "decimal(12,2)", "needs_review": "boolean", "base_variant_count": "int", "base_route_count": "int", "base_ingredient_count": "int"}


def canonical(df: DataFrame) -> DataFrame:
    """Every canonical column, typed; absent ones null. Short keys are accepted."""
    have = set(df.columns)

    def pick(name: str, key: str | None) -> Column:
        source = name if name in have else key if key in have else None
        return (F.lit(None) if source is None else F.col(f"`{source}`")).cast(TYPES.get(name, "string")).alias(name)

    return df.select(*[pick(n, k) for n, k in FIELDS.items()])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: a file or folder of objects with a ``records`` array."""
    fields = ", ".join(f"{k}: string" for k in FIELDS.values() if k)
    payload = spark.read.schema(f"records array<struct<{fields}>>").option("multiLine", True).json(path)
    return canonical(payload.select(F.explode("records").alias("r")).select("r.*"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: the canonical file with a header."""
    return canonical(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return canonical(spark.read.parquet(path))


def queries_frame(spark: SparkSession, requests: list) -> DataFrame:
    """SRC4: requests, strings or dicts, as (query_id, text, unreadable_mode,
    ending_fragment, result_limit); both spellings of the options count."""
    rows = []
    for i, r in enumerate(requests):
        r = {"text": r} if isinstance(r, str) else dict(r)
        mode = str(r.get("unreadableMode") or r.get("unreadable_mode") or "").lower()
        if mode not in ("none", "before", "middle", "after"):
            mode = "after" if r.get("unreadableContinuation") or r.get("unreadable_continuation") else "none"
        rows.append((str(r.get("query_id", i)), str(r.get("text") or r.get("query") or ""), mode, str(r.get("endingFragment") or r.get("ending_fragment") or ""), int(r.get("limit", 20))))
    return spark.createDataFrame(rows, "query_id string, text string, unreadable_mode string, ending_fragment string, result_limit int")


def derive(df: DataFrame) -> DataFrame:
    """Pass 1: keys that depend on the record alone."""
    name, base, other = filled("base_group_key", "commercial_name_en"), "base_group_key", filled("ingredient_key", "scientific_name")
    out = df.withColumns({
        "nn": norm(filled("commercial_name_en_norm", "commercial_name_en")), "arn": norm(filled("commercial_name_ar_norm", "commercial_name_ar")), "bn": norm(base), "ingn": norm(other),
        "c": compact(filled("commercial_name_en_compact", "commercial_name_en")), "base_norm": norm(name), "m_norm": norm("manufacturer"),
        "text_norm": norm(F.concat_ws(" ", "commercial_name_en", "commercial_name_ar", "base_group_key", "ingredient_key", "scientific_name")),
        "nums": numbers(norm(F.concat_ws(" ", "strengths_join", "commercial_name_en", "commercial_name_ar"))),
        "route_hints": F.filter(F.array_union(F.array(F.coalesce("route_family", F.lit(""))), route_hints(norm("detected_form_from_name"))), lambda r: r != ""),
        "warning_flags": warning_list("review_reasons"),
    })
    out = out.withColumns({"arc": squeeze("arn"), "bc": squeeze("bn"), "ingc": squeeze("ingn"), "headc": brand_head("base_norm")})
    return out.withColumns({"sk": skeleton("bc"), "ph": phonetic("bc"), "headsk": skeleton("headc")})


def head_families(derived: DataFrame) -> DataFrame:
    """A3: (headc, m_norm) cohorts of two bases or more. Two different bases are
    a smallest unlike the largest, so one pre-aggregated pass suffices."""
    own = derived.where((F.length("headc") >= 5) & (F.col("m_norm") != ""))
    return own.groupBy("headc", "m_norm").agg(F.min("bc").alias("lo"), F.max("bc").alias("hi")).where("lo <> hi").select("headc", "m_norm")


def base_stats(df: DataFrame) -> DataFrame:
    """Variants, routes and ingredients of each base."""
    return df.where("base_group_key is not null").groupBy("base_group_key").agg(F.count("*").cast("int").alias("bv"), F.countDistinct("route_family").cast("int").alias("br"), F.countDistinct("ingredient_key").cast("int").alias("bi"))


def prepare_catalog(df: DataFrame) -> DataFrame:
    """All derived fields; base counts are filled in where the source has none."""
    derived = derive(canonical(df))
    families = head_families(derived).withColumn("head_family", F.lit(True))
    out = derived.join(families, ["headc", "m_norm"], "left").withColumn("head_family", F.coalesce("head_family", F.lit(False)))
    out = out.withColumn("family_group_key", family_key("base_norm", F.when(F.col("head_family"), F.col("headc")).otherwise(F.lit(""))))
    out = out.join(base_stats(out), "base_group_key", "left")
    return out.withColumns({n: F.coalesce(n, k) for n, k in (("base_variant_count", "bv"), ("base_route_count", "br"), ("base_ingredient_count", "bi"))}).drop("bv", "br", "bi")


def prefix_danger(prepared: DataFrame, longest: int = 6) -> DataFrame:
    """A1: distinct bases, products, ingredients and routes for each prefix of
    the base, name and Arabic keys."""
    keys = F.array_distinct(F.filter(F.array("bc", "c", "arc"), lambda k: k != ""))
    parts = F.flatten(F.transform(keys, lambda k: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(k))), lambda n: F.substr(k, F.lit(1), n))))
    rows = prepared.select(F.explode(F.array_distinct(parts)).alias("prefix"), "bc", "c", "ingc", "route_family")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.groupBy("prefix").agg(F.countDistinct(some("bc")).alias("bases"), F.countDistinct(some("c")).alias("products"), F.countDistinct(some("ingc")).alias("ingredients"), F.countDistinct(some("route_family")).alias("routes"))


def short_registry(prepared: DataFrame) -> DataFrame:
    """A2: distinct keys of at most four characters."""
    keys = F.transform(F.array("bn", "bc", "arn", "arc", "nn", "c"), squeeze)
    return prepared.select(F.explode(keys).alias("key")).where("key <> '' and length(key) <= 4").distinct()


# Catalogue preparation (P1-P8): the outputs are documented, the rules are ours.

STRENGTH = r"(?i)\d+(?:\.\d+)?\s*(?:mcg|mg|gm|g|ml|iu|%)(?![a-z])"
PACKAGE = r"(?i)\d+\s*(?:tabs?|tablets?|caps?|capsules?|vials?|amps?|ampoules?|sachets?|supp)(?![a-z])"
FORMS = "TAB TABS TABLET TABLETS CAP CAPS CAPSULE CAPSULES SYRUP SUSP SUSPENSION VIAL VIALS AMP AMPS AMPOULE CREAM GEL OINT LOTION DROPS SPRAY SUPP SACHET SACHETS"


def base_key(name: Column | str) -> Column:
    """The name without strengths, packs and forms; the whole name if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(col(name), STRENGTH, " "), PACKAGE, " ")
    kept = F.filter(pieces(norm(bare)), lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in FORMS.split()]), t) & ~t.rlike("^[0-9]+$"))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(norm(name))


def strengths(name: Column | str) -> Column:
    """P2, from the raw name: normalising would lose points and per cent signs."""
    return F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(col(name), F.lit(STRENGTH), F.lit(0)), lambda s: F.upper(F.regexp_replace(s, r"\s+", "")))), "|")


def packages(name: Column | str) -> Column:
    """P3."""
    return F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(col(name), F.lit(PACKAGE), F.lit(0)), lambda s: F.upper(F.regexp_replace(s, r"\s+", " ")))), "|")


def form_of(name: Column | str) -> Column:
    """The first form word."""
    return F.coalesce(F.get(F.filter(pieces(norm(name)), lambda t: F.array_contains(F.array(*[F.lit(w) for w in FORMS.split()]), t)), F.lit(0)), F.lit(""))


def route_family_of(name: Column | str) -> Column:
    """The first route that the name hints at, else unknown."""
    return F.coalesce(F.get(route_hints(norm(name)), F.lit(0)), F.lit("unknown"))


def ingredients(c: Column | str) -> Column:
    """P5: ingredients between plus signs, semicolons or commas, trimmed and upper case."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[+;,]"), lambda s: F.upper(F.trim(s))), lambda s: s != "")


def manufacturer_chain(c: Column | str) -> tuple[Column, Column]:
    """Primary and parent, divided at the first '>' (ours: none is documented)."""
    parts = F.split(F.coalesce(col(c), F.lit("")), ">", 2)
    primary = F.trim(F.get(parts, F.lit(0)))
    return primary, F.coalesce(F.trim(F.get(parts, F.lit(1))), primary)


def class_top(c: Column | str) -> Column:
    """The first level of a class path."""
    return F.trim(F.get(F.split(F.coalesce(col(c), F.lit("")), "[.>/]"), F.lit(0)))


def review(df: DataFrame) -> DataFrame:
    """review_flags and needs_review. A price is an outlier beyond three
    inter-quartile ranges of its class; a conflict is one name with two bases or
    ingredients. Both come from aggregates that are joined back."""
    d = df.withColumns({"_n": norm("commercial_name_en"), "_hint": F.get(route_hints(norm("commercial_name_en")), F.lit(0))})
    names = d.groupBy("_n").agg(F.count("*").alias("_copies"), (F.min("base_group_key") != F.max("base_group_key")).alias("_bases"), (F.min("ingredient_key") != F.max("ingredient_key")).alias("_ings"))
    prices = d.groupBy("drug_class").agg(F.expr("percentile_approx(cast(price_egp as double), array(0.25, 0.75), 10000)").alias("_q"))
    d = d.join(names, "_n", "left").join(prices.withColumnRenamed("drug_class", "_dc"), F.col("drug_class").eqNullSafe(F.col("_dc")), "left")
    spread, price = F.col("_q")[1] - F.col("_q")[0], F.col("price_egp").cast("double")
    blank = lambda c: filled(c) == ""
    rules = [
        ("MISSING_COMPOSITION", blank("ingredient_key") & blank("scientific_name")), ("UNKNOWN_ROUTE", filled("route_family").isin("", "unknown")),
        ("NAME_STATUS_MARKER", F.col("_n").rlike("(^| )(CANCELLED|ILLEGAL|N A)( |$)")), ("MISSING_MANUFACTURER", blank("manufacturer")), ("MISSING_CLASS", blank("drug_class")),
        ("ROUTE_CONFLICT", F.col("_hint").isNotNull() & ~filled("route_family").isin("", "unknown") & (F.col("_hint") != F.col("route_family"))),
        ("DUPLICATE_OR_CONFLICT", (F.col("_copies") > 1) & (F.coalesce("_bases", F.lit(False)) | F.coalesce("_ings", F.lit(False)))),
        ("NON_MEDICINE_OR_METADATA", F.col("_n").rlike("(^| )(DATA|VERSION|TEST|METADATA)( |$)") | (F.col("_n") == "")),
        ("PRICE_OUTLIER", F.coalesce((price > F.col("_q")[1] + 3 * spread) | (price < F.col("_q")[0] - 3 * spread), F.lit(False))),
    ]
    flags = F.array_compact(F.array(*[F.when(cond, F.lit(flag)) for flag, cond in rules]))
    return d.withColumn("review_flags", flags).withColumn("needs_review", F.size("review_flags") > 0).drop("_n", "_hint", "_copies", "_bases", "_ings", "_dc", "_q")
