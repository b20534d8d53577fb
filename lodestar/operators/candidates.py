"""Candidate generation (J1-J19): equi-joins of query keys with postings.

A probe is a row (query_id, kind, key). The original stops probing once enough
records are found, by limits on running counts that depend on record order, and
skips deletion keys of many records; here every probe runs whole, so the
candidates are a superset. Queries that find fewer than FEW records are given all
family heads of their length as well.

Spark goes by the size of a catalogue's files, which knows neither of the keys that
a record is exploded to nor of compression, and would broadcast all postings through
the driver. So probes are stored and counted, and only they are ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.keys import confusable_with, deletes, first, first_letter_variants, keyboard_ratio, ngrams
from ..functions.normalize import alias_target, is_generic, mapping
from ..functions.lexicon import LEXICON
from ..functions.similarity import bounded_levenshtein
from ..sources.shared import stored
from .postings import document_frequency, union_all

FEW = 20
#: Probes up to which they are broadcast: some 10 MB.
MOST_PROBES = 100_000


def meet(asking: DataFrame, rows: DataFrame, on: list[str], most: int = MOST_PROBES) -> DataFrame:
    """Inner join of ``asking``, a stored table, with rows of a catalogue: at most
    ``most`` of ``asking`` are broadcast, more meet the rows by a shuffle."""
    return rows.join(F.broadcast(asking) if asking.count() <= most else asking.hint("merge"), on)


def _cut(c, n: int = 12):
    return F.substring(c, 1, n)


def probing_tokens() -> Column:
    """Tokens that generate candidates: of several tokens, no numbers and
    route words; of more than two, none of two characters; no generic ones
    beside specific ones."""
    many, routes = F.size("q_tokens"), mapping(LEXICON.routes)

    def keep(t: Column) -> Column:
        ranking_only = ((many > 1) & (t.rlike("^[0-9]+$") | F.try_element_at(routes, t).isNotNull())) | ((F.length(t) <= 2) & (many > 2))
        return ~ranking_only & ~(is_generic(t) & (F.size("q_specific") > 0))

    return F.filter("q_tokens", keep)


def probes(q: DataFrame) -> DataFrame:
    """Every probe with a fixed key (J1, J2, J4-J8, J10, J12-J15): one pass over
    the queries, each exploded to its (kind, key) pairs."""
    n = F.length("qc")
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("q_tokens"), F.lit(1))), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.array_join(F.slice("q_tokens", i, k), ""))))
    unit_deletes = F.flatten(F.transform("q_units", lambda u: F.filter(deletes(u["value"], u["threshold"]), lambda d: F.length(d) >= 3)))
    frames = F.filter(F.transform("q_units", lambda u: u["skeleton"]), lambda s: F.length(s) >= 3)
    numeric = F.when((F.size("q_generic") > 0) & (F.size("q_tokens") <= 3), F.filter("q_tokens", lambda t: t.rlike("^[0-9]{3,4}$")))
    sound, prefix12 = F.length("q_ph") >= 3, lambda a: F.transform(a, lambda c: _cut(c))
    wanted = [
        ("exact", F.array("qn", "qc")), ("exact", F.col("q_visual")), ("prefix", prefix12(F.array("qn", "qc"))), ("prefix", prefix12(first_letter_variants("qc"))), ("prefix", prefix12("q_visual")), ("prefix", numeric),
        ("suffix", F.when(n >= 4, F.array(_cut(F.reverse("qc"))))), ("baseExact", F.filter(windows, lambda w: F.length(w) >= 4)), ("baseExact", F.transform("q_tokens", lambda t: alias_target(t))), ("baseExact", F.array(alias_target("qc", "qn"))),
        ("token", F.col("q_probing")), ("headExact", F.array("qc")), ("delete", unit_deletes), ("headDelete", unit_deletes), ("skeleton", frames), ("skeletonPrefix", F.transform(frames, lambda s: _cut(s, 10))),
        ("phonetic", F.when(sound, F.array("q_ph"))), ("headPhonetic", F.when(sound, F.array("q_ph"))), ("phoneticPrefix", F.when(sound, F.array(_cut("q_ph")))),
    ]
    lists = q.withColumn("q_probing", probing_tokens()).select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), keys.alias("keys")) for k, keys in wanted])).alias("p"))
    return lists.select("query_id", "p.kind", F.explode("p.keys").alias("key")).where("key <> ''").distinct()


def rarest_grams(q: DataFrame, posted: DataFrame) -> DataFrame:
    """Of a query's grams that occur, the four rarest 4-grams, the five
    rarest 3-grams, and each probing token's rarest 3-gram."""
    long = F.length("qc") >= 3
    source = lambda kind, most, text, grams: F.struct(F.lit(kind).alias("kind"), F.lit(most).alias("most"), text.alias("t"), grams.alias("grams"))
    whole = F.array(source("grams4", 4, F.lit(""), F.when(long, ngrams("qc", 4))), source("grams", 5, F.lit(""), F.when(long, ngrams("qc", 3))))
    single = F.when(F.size("q_tokens") <= 3, F.transform(F.filter(F.array_distinct(probing_tokens()), lambda t: F.length(t) >= 3), lambda t: source("grams", 1, t, ngrams(t, 3))))
    rows = q.select("query_id", F.explode(F.concat(whole, F.coalesce(single, F.slice(whole, 1, 0)))).alias("s")).select("query_id", "s.kind", "s.most", "s.t", F.posexplode("s.grams").alias("at", "key"))
    rows = stored(rows, "grams")
    df = document_frequency(meet(stored(rows.select("kind", "key").distinct(), "gram-keys"), posted, ["kind", "key"]))
    rank = F.row_number().over(W.Window.partitionBy("query_id", "kind", "t").orderBy("df", "at"))
    return meet(rows, df, ["kind", "key"]).withColumn("r", rank).where("r <= most").select("query_id", "kind", "key").distinct()


def length_bands(q: DataFrame, prepared: DataFrame) -> DataFrame:
    """Heads and bases of like length and a first letter that is
    equal or confusable. The band is exploded to an equi-join on (length, first
    letter); edit distance and keyboard ratio stay as residual conditions."""
    n = F.length("qc")
    letters = F.array_distinct(F.filter(F.split(F.concat(first("qc"), confusable_with(first("qc"))), ""), lambda c: c != ""))
    band = lambda k, most: q.where(n.between(4, most)).select("query_id", "qc", F.explode(F.sequence(F.greatest(F.lit(1), n - k), n + k)).alias("len"), letters.alias("letters")).withColumn("letter", F.explode("letters")).drop("letters")
    heads = prepared.where(F.col("head_family") & (F.col("headc") != "")).select("candidate_id", "headc", F.length("headc").alias("len"), first("headc").alias("letter"))
    bases = prepared.where("bc <> ''").select("candidate_id", "bc", F.length("bc").alias("len"), first("bc").alias("letter"))
    near = meet(stored(band(2, 18), "bands"), heads, ["len", "letter"]).where(bounded_levenshtein("qc", "headc", 2).isNotNull())
    rescue = meet(stored(band(3, 12), "bands"), bases, ["len", "letter"])
    same = meet(stored(q.where(n.between(4, 18)).select("query_id", "qc", n.alias("len")), "bands"), bases.drop("letter"), ["len"]).where(keyboard_ratio("qc", "bc") >= 0.68)
    return union_all([x.select("query_id", "candidate_id") for x in (near, rescue, same)])


def candidates(q: DataFrame, prepared: DataFrame, posted: DataFrame) -> DataFrame:
    """Distinct (query_id, candidate_id) of all probes."""
    q = stored(q, "asked")
    wanted = stored(probes(q).unionByName(rarest_grams(q, posted)), "probes")
    found = meet(wanted, posted, ["kind", "key"]).select("query_id", "candidate_id").unionByName(length_bands(q, prepared))
    found = stored(found.distinct(), "candidates")
    answered = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= FEW).select("query_id")
    return found.unionByName(same_length_heads(q.join(answered, "query_id", "left_anti"), prepared)).distinct()


def same_length_heads(q: DataFrame, prepared: DataFrame) -> DataFrame:
    """J16's second half: all family heads of the query's length."""
    heads = prepared.where(F.col("head_family")).select("candidate_id", F.length("headc").alias("len"))
    asking = q.where(F.length("qc").between(4, 18)).select("query_id", F.length("qc").alias("len"))
    return meet(stored(asking, "lengths"), heads, ["len"]).select("query_id", "candidate_id")
