"""Query analysis: one row of derived fields for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import phonetic, skeleton, visual_variants
from ..functions.normalize import brand_compacts, brand_like, compact, generic_tokens, norm, numbers, route_hints, specific_tokens, squeeze, tokens

MAX_UNITS = 6


def analyze(queries: DataFrame) -> DataFrame:
    """Adds qn, qc and the q_ fields; blank queries are dropped."""
    out = queries.withColumns({"qn": norm("text"), "q_ending": compact("ending_fragment")}).where("qn <> ''")
    out = out.withColumns({"qc": squeeze("qn"), "q_tokens": tokens("qn"), "q_numbers": numbers("qn"), "q_routes": route_hints("qn"), "q_brands": brand_compacts("qn")})
    values = F.array_distinct(F.filter(F.concat(F.array("qc"), F.col("q_tokens")), lambda v: F.length(v) >= 4))
    units = F.transform(F.slice(values, 1, MAX_UNITS), lambda v: F.struct(v.alias("value"), F.when(F.length(v) <= 7, 1).otherwise(2).alias("threshold"), skeleton(v).alias("skeleton")))
    return out.withColumns({
        "q_generic": generic_tokens("q_tokens"), "q_specific": specific_tokens("q_tokens"), "q_visual": visual_variants("qc"), "q_ph": phonetic("qc"), "q_sk": skeleton("qc"),
        "q_units": F.when(F.size("q_tokens") <= 4, units).otherwise(F.slice(units, 1, 0)), "q_values": F.concat(F.array("qc"), F.filter("q_brands", lambda b: b != "")),
        "brand_like": brand_like("qn", F.size("q_tokens")) & (F.col("unreadable_mode") == "none"),
    })
