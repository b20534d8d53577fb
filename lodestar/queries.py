"""Registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import keys as K
from .functions import normalize as N
from .functions import similarity as S
from .operators import candidates as J
from .operators import decide as D
from .operators import evaluate as E
from .operators import rank as R
from .operators import score as SC
from .operators.postings import document_frequency, postings
from .operators.query import analyze
from .plans.search import Catalog, pair, search_batch
from .sources import catalog as C
from .sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue that the queries search, made from the part table."""
    kinds = {"STANDARD": ("oral_solid", "TABS"), "MEDIUM": ("oral_liquid", "SYRUP"), "PROMO": ("topical", "CREAM"), "LARGE": ("injection", "VIAL"), "SMALL": ("oral_solid", "CAPS")}
    route, form = (N.mapping({k: v[i] for k, v in kinds.items()}) for i in (0, 1))
    p = table(spark, sf_dir, "part")
    return C.canonical(p.select(
        F.col("p_partkey").cast("string").alias("candidate_id"), F.concat("p_name", F.lit(" "), "p_size", F.lit(" MG")).alias("commercial_name_en"), F.upper("p_name").alias("base_group_key"),
        F.upper(F.get(F.split("p_name", " "), F.lit(1))).alias("ingredient_key"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("drug_class"), F.col("p_retailprice").alias("price_egp"),
        F.coalesce(F.try_element_at(route, "p_type"), F.lit("unknown")).alias("route_family"), F.coalesce(F.try_element_at(form, "p_type"), F.lit("")).alias("detected_form_from_name"),
        F.when(F.col("p_size") % 10 == 0, "CANCELLED").when(F.col("p_size") % 7 == 0, "UNKNOWN_ROUTE|QUALITY_REVIEW").otherwise("").alias("review_reasons"),
    ))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prepare_catalog(part_catalog(spark, sf_dir))


#: Requests that the search queries ask, as (text, mode, ending).
ASKED = [
    ("smal widget", "none", ""), ("redplate", "none", ""), ("hot rng", "none", ""), ("large", "none", ""), ("old anvil", "none", ""), ("blu", "none", ""), ("COLD RINGS", "none", ""),
    ("new gear 12 mg", "none", ""), ("widget tabs", "none", ""), ("gizm0", "none", ""), ("small rod", "none", ""), ("n", "none", ""), ("hot plate syrup", "none", ""), ("LAGRE BOLT", "none", ""),
    ("cold", "after", ""), ("gear", "before", ""), ("bl", "middle", "rod"),
]
ASKED_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {O.lit(t)}, '{m}', '{e}')" for i, (t, m, e) in enumerate(ASKED)) + ") v(query_id, text, mode, ending))"
ANALYZED_SQL = f"""{ASKED_SQL},
q1 AS (SELECT *, {O.norm('text')} AS qn, {O.squeeze(O.norm('ending'))} AS q_ending FROM q),
q2 AS (SELECT *, {O.squeeze('qn')} AS qc, {O.tokens('qn')} AS toks FROM q1 WHERE qn <> ''),
aq AS (SELECT *, list_filter(toks, lambda t: list_contains({O.GENERIC}, t)) AS generic, list_filter(toks, lambda t: NOT list_contains({O.GENERIC}, t)) AS specific,
              {O.phonetic('qc')} AS q_ph, {O.skeleton('qc')} AS q_sk, {O.visual('qc')} AS q_visual,
              coalesce({O.ALIASES}[qc], {O.ALIASES}[qn], '') AS target FROM q2)"""


def asked(spark: SparkSession) -> DataFrame:
    rows = [{"query_id": str(i), "text": t, "unreadable_mode": m, "ending_fragment": e} for i, (t, m, e) in enumerate(ASKED)]
    return C.queries_frame(spark, rows)


# --- Normalisation (N1-N14) ---


@query(f"SELECT doc_id, {O.norm('text')} AS norm FROM documents")
def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", N.norm("text").alias("norm"))


@query(f"SELECT doc_id, {O.squeeze(O.norm('text'))} AS compact FROM documents")
def compact_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", N.compact("text").alias("compact"))


@query(f"SELECT doc_id, {O.joined(O.tokens(O.norm('text')))} AS tokens FROM documents")
def tokens_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(N.tokens(N.norm("text")), " ").alias("tokens"))


@query(f"SELECT page_id, {O.sorted_set(O.numbers(O.norm('html')))} AS numbers FROM pages")
def numbers_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(N.numbers(N.norm("html"))), " ").alias("numbers"))


@query(f"WITH {O.CATALOG.strip()} SELECT candidate_id, {O.sorted_set(O.routes(O.norm(chr(39).join(['name || ', ' ', ' || form || ', ' eye']) + chr(39))))} AS hints FROM cat")
def route_hints_parts(spark, d):
    text = F.concat("commercial_name_en", F.lit(" "), "detected_form_from_name", F.lit(" eye"))
    return part_catalog(spark, d).select("candidate_id", F.array_join(F.array_sort(N.route_hints(N.norm(text))), " ").alias("hints"))


LITERALS = [
    "augmentin 1 gm tabs", "ogmentin 625", "bandol cold", "اوجمنتين 1 جم", "ليبتور ٨٠", "data-version", "CA", "1.5% cream", "500MG", "1جم", "أُمبولـة", "straße é", "", "  a--b  ", "panadol extra plus", "PLUS EXTRA", "vitamin c 500 mg tabs", "new brand 10 20 ml", "12", "syrup",
]
LITERALS_SQL = "l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {O.lit(t)})" for i, t in enumerate(LITERALS)) + ") v(id, text)), n AS (SELECT id, " + O.norm("text") + " AS n FROM l), p AS (SELECT *, " + O.pieces("n") + " AS p FROM n), c AS (SELECT *, " + O.context("p") + " AS c FROM p)"


def literals(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LITERALS)), "id int, text string").withColumn("n", N.norm("text"))


@query(f"WITH {LITERALS_SQL} SELECT id, n AS norm, {O.squeeze('n')} AS compact, {O.sorted_set(O.numbers('n'))} AS numbers FROM p")
def arabic_normalize_literals(spark, d):
    return literals(spark).select("id", F.col("n").alias("norm"), N.squeeze("n").alias("compact"), F.array_join(F.array_sort(N.numbers("n")), " ").alias("numbers"))


@query(f"WITH {LITERALS_SQL} SELECT id, {O.joined('c')} AS context FROM c")
def clean_context_tokens(spark, d):
    return literals(spark).select("id", F.array_join(N.context_tokens("n"), " ").alias("context"))


@query(f"WITH {LITERALS_SQL} SELECT id, {O.joined(O.brands('c'))} AS brands FROM c")
def brand_compacts(spark, d):
    return literals(spark).select("id", F.array_join(N.brand_compacts("n"), " ").alias("brands"))


@query(f"WITH p AS (SELECT doc_id, {O.pieces(O.norm('text'))} AS p FROM documents) SELECT doc_id, {O.head('p')} AS head FROM p")
def brand_head(spark, d):
    return table(spark, d, "documents").select("doc_id", N.brand_head(N.norm("text")).alias("head"))


@query(f"WITH {LITERALS_SQL} SELECT id, {O.family('n')} AS family FROM p")
def family_group_key(spark, d):
    return literals(spark).select("id", N.family_key("n").alias("family"))


@query(f"WITH {LITERALS_SQL}, t AS (SELECT id, unnest(p) AS t FROM p) SELECT id, t, coalesce({O.ALIASES}[t], '') AS target FROM t")
def alias_lookup(spark, d):
    return literals(spark).select("id", F.explode(N.pieces("n")).alias("t")).withColumn("target", N.alias_target("t"))


@query(f"WITH {LITERALS_SQL}, t AS (SELECT id, n, p, {O.tokens('n')} AS t FROM p) SELECT id, {O.joined(f'list_filter(t, lambda x: list_contains({O.GENERIC}, x))')} AS generic, {O.joined(f'list_filter(t, lambda x: NOT list_contains({O.GENERIC}, x))')} AS specific, length({O.squeeze('n')}) BETWEEN 4 AND 20 AND len(t) <= 3 AND len(list_filter(p, lambda x: {O.unit('x')})) = 0 AS brand_like FROM t")
def token_split(spark, d):
    t = literals(spark).withColumn("t", N.tokens("n"))
    return t.select("id", F.array_join(N.generic_tokens("t"), " ").alias("generic"), F.array_join(N.specific_tokens("t"), " ").alias("specific"), N.brand_like("n", F.size("t")).alias("brand_like"))


@query(f"WITH {O.CATALOG.strip()} SELECT candidate_id, array_to_string(list_filter(list_transform(string_split(reasons, '|'), lambda x: trim(x)), lambda x: x <> ''), ' ') AS flags FROM cat")
def warning_flags(spark, d):
    return part_catalog(spark, d).select("candidate_id", F.array_join(N.warning_list("review_reasons"), " ").alias("flags"))


# --- Keys (K1-K9) ---


def words(spark, d) -> DataFrame:
    """Distinct plain words of the documents, 4 to 18 letters."""
    every = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.upper(F.coalesce("text", F.lit(""))), F.lit("[A-Z]+"), F.lit(0))).alias("w"))
    return every.where(F.length("w").between(4, 18)).distinct()


@query(f"WITH {O.WORDS.strip()} SELECT w, {O.skeleton('w')} AS k FROM words")
def skeleton_words(spark, d):
    return words(spark, d).withColumn("k", K.skeleton("w"))


@query(f"WITH {O.WORDS.strip()} SELECT w, {O.phonetic('w')} AS k FROM words")
def phonetic_words(spark, d):
    return words(spark, d).withColumn("k", K.phonetic("w"))


@query(f"WITH {O.WORDS.strip()} SELECT w, {O.sorted_set(O.ngrams('w', 3))} AS grams, len({O.ngrams('w', 4)}) AS n4 FROM words")
def ngram_sets(spark, d):
    return words(spark, d).select("w", F.array_join(F.array_sort(K.ngrams("w", 3)), " ").alias("grams"), F.size(K.ngrams("w", 4)).cast("long").alias("n4"))


@query(f"WITH {O.WORDS.strip()} SELECT w, md5({O.sorted_set(O.deletes('w', 'length(w) > 7'))}) AS deletes FROM words")
def delete_neighborhood(spark, d):
    return words(spark, d).select("w", F.md5(F.array_join(F.array_sort(K.deletes("w", K.max_deletes("w"))), " ").cast("binary")).alias("deletes"))


@query(f"WITH {O.WORDS.strip()} SELECT w, {O.sorted_set(O.visual('w'))} AS variants FROM words")
def visual_variants(spark, d):
    return words(spark, d).select("w", F.array_join(F.array_sort(K.visual_variants("w")), " ").alias("variants"))


@query(f"WITH {O.WORDS.strip()} SELECT w, array_to_string(list_transform(range(3, least(12, length(w)) + 1), lambda n: substr(reverse(w), 1, n)), ' ') AS suffixes FROM words")
def suffix_keys(spark, d):
    return words(spark, d).select("w", F.array_join(K.suffix_keys("w"), " ").alias("suffixes"))


def word_pairs(spark, d) -> DataFrame:
    """Each word with the words of catalogue names of its first letter and about its length."""
    h = table(spark, d, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("h")).distinct()
    return words(spark, d).join(h, (F.substring("w", 1, 1) == F.substring("h", 1, 1)) & (F.abs(F.length("w") - F.length("h")) <= 2))


@query(f"WITH {O.PAIRS.strip()} SELECT w, h, round({O.keyboard('w', 'h')}, 6) AS ratio, {O.confusable('substr(w, 2)', 'substr(h, 2)')} AS confusable FROM pairs")
def keyboard_ratio(spark, d):
    return word_pairs(spark, d).select("w", "h", F.round(K.keyboard_ratio("w", "h"), 6).alias("ratio"), K.firsts_confusable(F.expr("substring(w, 2)"), F.expr("substring(h, 2)")).alias("confusable"))


# --- Similarity (S1-S16) ---


@query(f"WITH {O.PAIRS.strip()} SELECT w, h, CASE WHEN levenshtein(w, h) <= 2 THEN levenshtein(w, h) END AS distance FROM pairs")
def bounded_levenshtein(spark, d):
    return word_pairs(spark, d).withColumn("distance", S.bounded_levenshtein("w", "h", 2).cast("long"))


@query(f"WITH {O.PAIRS.strip()} SELECT w, h, round({O.jaccard(O.ngrams('w', 2), O.ngrams('h', 2))}, 6) AS jaccard FROM pairs")
def ngram_jaccard(spark, d):
    return word_pairs(spark, d).select("w", "h", F.round(S.jaccard(K.ngrams("w", 2), K.ngrams("h", 2)), 6).alias("jaccard"))


@query(f"WITH {O.PAIRS.strip()} SELECT w, h, round({O.prefix_score('w', 'h')}, 6) AS prefix, round({O.suffix_score('w', 'h')}, 6) AS suffix, round({O.position_score('w', 'h')}, 6) AS positional, round({O.coverage('w', 'h')}, 6) AS coverage FROM pairs")
def prefix_suffix_scores(spark, d):
    return word_pairs(spark, d).select("w", "h", *[F.round(f("w", "h"), 6).alias(n) for n, f in (("prefix", S.prefix_score), ("suffix", S.suffix_score), ("positional", S.position_score), ("coverage", S.coverage))])


@query(f"WITH {O.PAIRS.strip()} SELECT w, h, round({O.subsequence('h', 'w')}, 6) AS score FROM pairs")
def subsequence_score(spark, d):
    return word_pairs(spark, d).select("w", "h", F.round(S.subsequence_score("h", "w"), 6).alias("score"))


@query(f"WITH RECURSIVE {O.PAIRS.strip()}, {O.OSA.strip()} SELECT w, h, CAST(raw AS INTEGER) AS raw FROM osa")
def osa_distance(spark, d):
    return word_pairs(spark, d).withColumn("d", S.osa("w", "h")).select("w", "h", F.col("d.raw").alias("raw"))


@query(f"WITH RECURSIVE {O.PAIRS.strip()}, {O.OSA.strip()} SELECT w, h, round(weighted, 6) AS weighted, round(greatest(0.0, 1 - weighted / greatest(length(w), length(h))), 6) AS similarity FROM osa")
def osa_weighted(spark, d):
    return word_pairs(spark, d).withColumn("d", S.osa("w", "h")).select("w", "h", F.round("d.weighted", 6).alias("weighted"), F.round(S.edit_similarity("d.weighted", "w", "h"), 6).alias("similarity"))


def _similar(q: str, t: str) -> str:
    return f"CASE WHEN {q} = '' OR {t} = '' THEN 0.0 WHEN {q} = {t} THEN 1.0 WHEN starts_with({q}, {t}) OR starts_with({t}, {q}) THEN least(length({q}), length({t})) / greatest(length({q}), length({t})) ELSE 0.75 * {O.subsequence(q, t)} END"


@query(f"""WITH RECURSIVE {O.PAIRS.strip()}, {O.OSA.strip()},
k AS (SELECT *, {O.skeleton('w')} AS ws, {O.skeleton('h')} AS hs, {O.phonetic('w')} AS wp, {O.phonetic('h')} AS hp, {O.ngrams('w', 3)} AS wg, {O.ngrams('h', 3)} AS hg, greatest(length(w), length(h)) AS longest, abs(length(w) - length(h)) AS gap FROM osa),
m AS (SELECT w, h, gap, greatest(0.0, 1 - raw / longest) AS edit, greatest(0.0, 1 - weighted / longest) AS weighted, {O.prefix_score('w', 'h')} AS prefix, {O.suffix_score('w', 'h')} AS suffix, {O.jaccard('wg', 'hg')} AS grams,
             {_similar('ws', 'hs')} AS sk, {_similar('wp', 'hp')} AS ph, {O.subsequence('w', 'h')} AS subseq, {O.position_score('w', 'h')} AS pos, {O.coverage('w', 'h')} AS cov FROM k)
SELECT w, h, round(0.58 * edit + 0.52 * weighted + 0.16 * prefix + 0.10 * suffix + 0.18 * grams + 0.16 * sk + 0.14 * ph + 0.10 * subseq + 0.24 * pos + 0.16 * cov + 0.12
  + CASE WHEN gap <= 1 AND weighted >= 0.76 THEN 0.18 ELSE 0 END + CASE WHEN prefix >= 0.55 AND weighted >= 0.66 THEN 0.08 ELSE 0 END + CASE WHEN weighted >= 0.84 AND pos >= 0.70 THEN 0.22 ELSE 0 END
  - CASE WHEN gap >= 2 AND (starts_with(w, h) OR starts_with(h, w)) AND cov < 0.86 AND weighted < 0.84 THEN 0.18 + least(0.24, 0.05 * gap) ELSE 0 END
  - CASE WHEN greatest(edit, weighted) < 0.58 AND greatest(sk, ph) < 0.72 THEN 0.20 ELSE 0 END - CASE WHEN prefix < 0.30 AND grams < 0.12 AND greatest(edit, weighted) < 0.70 THEN 0.10 ELSE 0 END, 6) AS rescue
FROM m""")
def rescue_scores(spark, d):
    rows = word_pairs(spark, d).withColumn("d", S.osa("w", "h"))
    rows = rows.withColumn("m", F.struct(*[v.alias(k) for k, v in S.rescue_parts("w", "h", F.col("d.raw"), F.col("d.weighted")).items()]))
    return rows.select("w", "h", F.round(S.rescue_score("w", "h", F.col("m")), 6).alias("rescue"))


# --- Catalogue, statistics, postings (1.3, A1-A4, A7, I1-I18) ---


@query(f"WITH {O.PREPARED.strip()} SELECT candidate_id, nn, c, bn, bc, ingn, ingc, headc, sk, ph, head_family, family_group_key, {O.sorted_set(O.numbers('nn'))} AS nums FROM prep")
def prepared_catalog(spark, d):
    return prepared(spark, d).select("candidate_id", "nn", "c", "bn", "bc", "ingn", "ingc", "headc", "sk", "ph", "head_family", "family_group_key", F.array_join(F.array_sort("nums"), " ").alias("nums"))


@query(f"""WITH {O.PREPARED.strip()}, k AS (SELECT bc, c, ingc, route, unnest(list_distinct(flatten(list_transform([bc, c], lambda x: list_transform(range(1, least(6, length(x)) + 1), lambda n: substr(x, 1, n)))))) AS prefix FROM prep)
SELECT prefix, count(DISTINCT bc) AS bases, count(DISTINCT c) AS products, count(DISTINCT ingc) AS ingredients, count(DISTINCT route) AS routes FROM k GROUP BY prefix""")
def prefix_danger(spark, d):
    return C.prefix_danger(prepared(spark, d))


@query(f"WITH {O.PREPARED.strip()}, k AS (SELECT unnest([bc, c]) AS key FROM prep) SELECT DISTINCT key FROM k WHERE key <> '' AND length(key) <= 4")
def short_registry(spark, d):
    return C.short_registry(prepared(spark, d))


@query(f"WITH {O.PREPARED.strip()} SELECT * FROM fam")
def head_family(spark, d):
    return C.head_families(C.derive(part_catalog(spark, d)))


@query(f"WITH {O.CATALOG.strip()} SELECT base AS base_group_key, CAST(count(*) AS INTEGER) AS bv, CAST(count(DISTINCT route) AS INTEGER) AS br, CAST(count(DISTINCT ing) AS INTEGER) AS bi FROM cat GROUP BY base")
def base_stats(spark, d):
    return C.base_stats(part_catalog(spark, d))


def _postings(kind: str, keys: str):
    sql = f"WITH {O.PREPARED.strip()}, k AS (SELECT candidate_id, unnest(list_distinct({keys})) AS key FROM prep) SELECT '{kind}' AS kind, key, candidate_id FROM k WHERE key <> ''"

    def run(spark, d):
        return postings(prepared(spark, d), [kind])

    run.__name__ = f"postings_{kind}"
    query(sql)(run)


_parts = lambda fields, least, most: f"flatten(list_transform([{fields}], lambda x: list_transform(range({least}, least({most}, length(x)) + 1), lambda n: substr(x, 1, n))))"
_grams = lambda n: f"flatten(list_transform([c, bc, ingc], lambda x: {O.ngrams('x', n)}))"
_words = O.tokens("concat_ws(' ', nn, bn, ingn)")
for _kind, _keys in {
    "exact": "[nn, c, bn, bc, ingn, ingc]", "prefix": _parts("nn, c, bn, bc, ingn, ingc", 2, 12), "grams": _grams(3), "grams4": _grams(4), "suffix": _parts("reverse(c), reverse(bc), reverse(ingc)", 3, 12), "token": _words,
    "skeleton": "[sk]", "skeletonPrefix": _parts("sk", 2, 10), "baseExact": "[bc]", "baseLength": "[CAST(length(bc) AS VARCHAR)]", "delete": f"list_filter({O.deletes('bc', 'length(bc) > 7')}, lambda x: length(x) >= 3)",
    "phonetic": "[ph]", "phoneticPrefix": _parts("ph", 3, 12), "headExact": "CASE WHEN head_family THEN [headc] ELSE [] END", "headLength": "CASE WHEN head_family THEN [CAST(length(headc) AS VARCHAR)] ELSE [] END",
    "headPhonetic": f"CASE WHEN head_family THEN [{O.phonetic('headc')}] ELSE [] END", "headDelete": f"CASE WHEN head_family THEN list_filter({O.deletes('headc', 'true')}, lambda x: length(x) >= 3) ELSE [] END",
}.items():
    _postings(_kind, _keys)


@query(f"WITH {O.PREPARED.strip()}, k AS (SELECT candidate_id, unnest(list_distinct({_grams(3)})) AS key FROM prep) SELECT 'grams' AS kind, key, count(*) AS df FROM k GROUP BY key")
def gram_df(spark, d):
    return document_frequency(postings(prepared(spark, d), ["grams"]))


# --- Candidates (J1-J20) ---


def _probe_join(spark, d, kinds: list[str]) -> DataFrame:
    wanted = stored(J.probes(analyze(asked(spark))).where(F.col("kind").isin(*kinds)), "probes")
    return J.meet(wanted, postings(prepared(spark, d), kinds), ["kind", "key"]).select("query_id", "candidate_id").distinct()


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL}, keys AS (SELECT query_id, unnest(list_concat([qn, qc], q_visual)) AS key FROM aq)
SELECT DISTINCT query_id, candidate_id FROM keys JOIN prep ON key IN (nn, c, bn, bc, ingn, ingc)""")
def candidates_exact(spark, d):
    return _probe_join(spark, d, ["exact"])


@query(f"WITH {O.PREPARED.strip()}, {ANALYZED_SQL} SELECT DISTINCT query_id, candidate_id FROM aq JOIN prep ON length(q_ph) >= 3 AND starts_with(ph, substr(q_ph, 1, 12))")
def candidates_phonetic(spark, d):
    return _probe_join(spark, d, ["phonetic", "phoneticPrefix"])


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL},
dl AS (SELECT candidate_id, unnest(list_filter({O.deletes('bc', 'length(bc) > 7')}, lambda x: length(x) >= 3)) AS key FROM prep),
u AS (SELECT query_id, unnest(CASE WHEN len(toks) <= 4 THEN list_filter(list_distinct(list_concat([qc], toks)), lambda v: length(v) >= 4) ELSE [] END) AS v FROM aq),
k AS (SELECT query_id, unnest(list_filter({O.deletes('v', 'length(v) > 7')}, lambda x: length(x) >= 3)) AS key FROM u)
SELECT DISTINCT query_id, candidate_id FROM k JOIN dl USING (key)""")
def candidates_delete(spark, d):
    return _probe_join(spark, d, ["delete"])


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL},
g AS (SELECT candidate_id, unnest(list_distinct({_grams(3)})) AS key, 'grams' AS kind FROM prep UNION ALL SELECT candidate_id, unnest(list_distinct({_grams(4)})), 'grams4' FROM prep),
df AS (SELECT kind, key, count(*) AS df FROM g GROUP BY ALL),
whole AS (SELECT query_id, '' AS t, kind, n AS most, unnest(range(1, length(qc) - len + 2)) AS pos, len, qc AS src FROM aq, (VALUES ('grams4', 4, 4), ('grams', 5, 3)) v(kind, n, len) WHERE length(qc) >= 3),
tk AS (SELECT query_id, len(toks) AS many, len(specific) AS n_specific, unnest(toks) AS t FROM aq),
single AS (SELECT query_id, t, 'grams' AS kind, 1 AS most, unnest(range(1, length(t) - 1)) AS pos, 3 AS len, t AS src FROM tk
           WHERE length(t) >= 3 AND many <= 3 AND NOT (many > 1 AND (regexp_full_match(t, '[0-9]+') OR {O.ROUTES}[t] IS NOT NULL)) AND NOT (list_contains({O.GENERIC}, t) AND n_specific > 0)),
e AS (SELECT query_id, t, kind, most, substr(src, CAST(pos AS INTEGER), len) AS key, min(pos) AS pos FROM (SELECT * FROM whole UNION ALL SELECT * FROM single) GROUP BY ALL),
r AS (SELECT e.*, row_number() OVER (PARTITION BY query_id, kind, t ORDER BY df, pos) AS r FROM e JOIN df USING (kind, key))
SELECT DISTINCT query_id, candidate_id FROM r JOIN g USING (kind, key) WHERE r <= most""")
def candidates_rarest_gram(spark, d):
    posted = postings(prepared(spark, d), ["grams", "grams4"])
    wanted = stored(J.rarest_grams(analyze(asked(spark)), posted), "probes")
    return J.meet(wanted, posted, ["kind", "key"]).select("query_id", "candidate_id").distinct()


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL},
same AS (SELECT query_id, candidate_id, substr(qc, 1, 1) = substr(headc, 1, 1) OR {O.confusable('qc', 'headc')} AS heads, substr(qc, 1, 1) = substr(bc, 1, 1) OR {O.confusable('qc', 'bc')} AS bases, qc, bc, headc, head_family FROM aq, prep)
SELECT DISTINCT query_id, candidate_id FROM same
WHERE (length(qc) BETWEEN 4 AND 18 AND head_family AND heads AND abs(length(qc) - length(headc)) <= 2 AND levenshtein(qc, headc) <= 2)
   OR (length(qc) BETWEEN 4 AND 12 AND bases AND abs(length(qc) - length(bc)) <= 3) OR {O.keyboard('qc', 'bc')} >= 0.68""")
def candidates_length_band(spark, d):
    return J.length_bands(analyze(asked(spark)), prepared(spark, d)).distinct()


@query()
def candidates_union(spark, d):
    cat = stored(prepared(spark, d), "catalog")
    return J.candidates(analyze(asked(spark)), cat, postings(cat))


# --- Scoring (SC1-SC44) ---


def _pairs(spark, d) -> DataFrame:
    return pair(Catalog(prepared(spark, d)), analyze(asked(spark)), True)


def _points(name: str, parts: Callable, rules: list[tuple[str, str, str]]) -> None:
    """Registers a query for the points and signals of ``parts``; ``rules`` are
    its signals in SQL: name (or expression), points, condition."""

    def run(spark, d):
        rows = _pairs(spark, d).withColumn("a", parts())
        signals = F.array_join(F.array_sort(F.array_distinct(F.transform("a", lambda x: x["signal"]))), "|").alias("signals")
        return rows.select("query_id", "candidate_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["pts"]), 6).alias("points"), signals).where(F.size("a") > 0)

    made = ", ".join(f"CASE WHEN {cond} THEN {{'s': {n if n.startswith('concat') else O.lit(n)}, 'p': CAST({pts} AS DOUBLE)}} END" for n, pts, cond in rules)
    sql = f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL}, x AS (SELECT query_id, candidate_id, list_filter([{made}], lambda e: e IS NOT NULL) AS a FROM aq, prep)
SELECT query_id, candidate_id, round(list_sum(list_transform(a, lambda e: e.p)), 6) AS points, array_to_string(list_sort(list_distinct(list_transform(a, lambda e: e.s))), '|') AS signals FROM x WHERE len(a) > 0"""
    run.__name__ = name
    query(sql)(run)


_meets = lambda t: f"({t} <> '' AND (bn = {t} OR starts_with(bn, {t} || ' ') OR starts_with(bc, {t})))"
_n18, _c18, _same = "least(length(qn), 18)", "least(length(qc), 18)", "substr(qc, 1, 1) = substr(bc, 1, 1)"
_points("score_exact_prefix", SC.exact_and_prefix, [
    ("exact_name", "1200", "nn = qn"), ("exact_compact", "1160", "c = qc"), ("exact_base_group", "980", "bn = qn OR bc = qc"), ("exact_ingredient", "720", "ingn = qn OR ingc = qc"), ("heard_spelling_alias", "1700", _meets("target")),
    ("prefix_name", f"420 + {_n18}", "length(qn) >= 2 AND starts_with(nn, qn)"), ("prefix_base", f"390 + {_n18}", "length(qn) >= 2 AND starts_with(bn, qn)"), ("prefix_ingredient", "260", "length(qn) >= 2 AND starts_with(ingn, qn)"),
    ("prefix_compact", f"380 + {_c18}", "length(qc) >= 3 AND starts_with(c, qc)"), ("prefix_base_compact", f"390 + {_c18}", "length(qc) >= 3 AND starts_with(bc, qc)"), ("contains_compact", "180", "length(qc) >= 3 AND contains(c, qc)"),
    ("query_contains_base", "360", "length(qc) >= 3 AND length(bc) >= 4 AND contains(qc, bc)"),
])
_lev = "levenshtein(v, bc)"
_unit = "list_filter(list_distinct(list_concat([qc], toks)), lambda v: length(v) >= 4)"
_points("score_keys", lambda: F.concat(SC.key_awards(), SC.visual_awards()), [
    ("drug_phonetic_key", "500", "length(q_ph) >= 3 AND q_ph = ph"), ("drug_phonetic_prefix", "650", "length(q_ph) >= 3 AND ph <> q_ph AND starts_with(ph, q_ph)"), ("phonetic_first_char", "250", f"length(q_ph) >= 3 AND ph <> '' AND {_same}"),
    ("brand_head_consonant_frame", f"1200 * ({O.coverage('qc', 'headc')})", f"len(toks) = 1 AND length(qc) >= 4 AND head_family AND contains(bn, ' ') AND length(q_sk) >= 3 AND q_sk = {O.skeleton('headc')} AND ({O.coverage('qc', 'headc')}) >= 0.60"),
    ("concat('brand_head_ed', levenshtein(qc, headc))", "400 - 60 * levenshtein(qc, headc)", f"len(toks) = 1 AND length(qc) >= 4 AND head_family AND contains(bn, ' ') AND levenshtein(qc, headc) <= 2 AND (substr(qc, 1, 1) = substr(headc, 1, 1) OR {O.confusable('qc', 'headc')})"),
    ("visual_confusion_candidate", "210", "len(list_filter(q_visual, lambda v: starts_with(bc, v) OR starts_with(c, v))) > 0"),
    ("keyboard_proximity", f"250 * ({O.keyboard('qc', 'bc')})", f"({O.keyboard('qc', 'bc')}) >= 0.68"), ("keyboard_first_char", "160", f"({O.keyboard('qc', 'bc')}) >= 0.68 AND {_same}"),
])
_hints = f"list_concat([route], {O.routes(O.norm('form'))})"
_points("score_context", lambda: F.concat(SC.context_awards(), SC.context_facts()), [
    ("generic_context_match", "560", "len(list_filter(specific, lambda t: list_contains(string_split(nn, ' '), t) OR list_contains(bp, t) OR contains(c, t) OR contains(bc, t))) > 0 AND len(list_filter(generic, lambda t: list_contains(string_split(nn, ' '), t) OR list_contains(bp, t) OR contains(c, t) OR contains(bc, t))) > 0"),
    ("number_match", "52", f"list_has_any({O.numbers('qn')}, {O.numbers('nn')})"), ("form_route_match", "58", f"list_has_any({O.routes('qn')}, {_hints})"),
    ("form_route_mismatch", "-16", f"len({O.routes('qn')}) > 0 AND NOT list_has_any({O.routes('qn')}, {_hints}) AND route <> 'unknown'"),
    ("quality_status_penalty", "-8", "contains(reasons, 'UNKNOWN_ROUTE')"), ("quality_status_penalty", "-28", "reasons = 'CANCELLED'"), ("generic_dominance_penalty", "-420", f"len(specific) > 0 AND list_contains({O.GENERIC}, bc)"),
])


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL},
t AS (SELECT query_id, unnest(toks) AS t, unnest(range(1, len(toks) + 1)) AS i FROM aq),
g AS (SELECT query_id, candidate_id, i, NOT list_contains({O.GENERIC}, t) AS specific, t, coalesce({O.ALIASES}[t], '') AS alias, prep.* EXCLUDE (candidate_id) FROM t, prep),
s AS (SELECT query_id, candidate_id, CASE WHEN {_meets('alias')} THEN {{'s': 'heard_spelling_alias', 'p': 1700, 'h': 1}}
  WHEN specific AND (list_contains(bp, t) OR bc = t) THEN {{'s': 'token_base', 'p': 210, 'h': 1}}
  WHEN specific AND length(t) >= 4 AND starts_with(bc, t) THEN {{'s': 'context_clean_prefix_base', 'p': 460 + least(length(t), 18), 'h': 1}}
  WHEN specific AND length(t) >= 4 AND contains(bc, t) THEN {{'s': 'context_clean_contains_base', 'p': 260, 'h': 1}}
  WHEN list_contains(string_split(nn, ' '), t) THEN {{'s': 'token_name', 'p': 140, 'h': 1}} WHEN list_contains(string_split(ingn, ' '), t) THEN {{'s': 'token_ingredient', 'p': 80, 'h': 0}}
  WHEN specific AND length(t) >= 3 AND contains(concat_ws(' ', nn, bn, ingn), t) THEN {{'s': 'token_contains', 'p': 42, 'h': 0}} END AS a FROM g)
SELECT query_id, candidate_id, CAST(sum(a.p) + CASE WHEN sum(a.h) >= 2 THEN 160 * sum(a.h) ELSE 0 END AS DOUBLE) AS points, CAST(sum(a.h) AS BIGINT) AS hits FROM s WHERE a IS NOT NULL GROUP BY ALL""")
def score_tokens(spark, d):
    rows = _pairs(spark, d).withColumn("a", SC.token_awards()).where(F.size("a") > 0)
    hits = F.size(F.filter("a", lambda x: ~x["signal"].isin("token_ingredient", "token_contains", "multi_token_match")))
    return rows.select("query_id", "candidate_id", F.aggregate("a", F.lit(0.0), lambda s, x: s + x["pts"]).alias("points"), hits.cast("long").alias("hits"))


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL},
u AS (SELECT query_id, unnest(CASE WHEN len(toks) <= 4 THEN ({_unit})[1:6] ELSE [] END) AS v FROM aq), us AS (SELECT *, {O.skeleton('v')} AS vs FROM u),
s AS (SELECT query_id, candidate_id, CASE WHEN length(v) <= 32 AND bc <> '' AND {_lev} <= CASE WHEN length(v) <= 7 THEN 1 ELSE 2 END THEN 250 - 60 * {_lev} ELSE 0 END AS close, CASE WHEN length(vs) >= 3 AND vs = sk THEN 170 ELSE 0 END AS frame FROM us, prep)
SELECT query_id, candidate_id, CAST(sum(close + frame) AS DOUBLE) AS points FROM s GROUP BY ALL HAVING sum(close + frame) > 0""")
def score_fuzzy(spark, d):
    rows = _pairs(spark, d).withColumn("a", SC.fuzzy_awards()).where(F.size("a") > 0)
    return rows.select("query_id", "candidate_id", F.aggregate("a", F.lit(0.0), lambda s, x: s + x["pts"]).alias("points"))


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL} SELECT query_id, candidate_id FROM aq, prep
WHERE CASE mode WHEN 'after' THEN starts_with(bc, qc) AND length(bc) > length(qc) WHEN 'before' THEN ends_with(bc, qc) AND length(bc) > length(qc)
  WHEN 'middle' THEN q_ending <> '' AND starts_with(bc, qc) AND ends_with(bc, q_ending) AND length(bc) > length(qc) + length(q_ending) ELSE false END""")
def unreadable_patterns(spark, d):
    return _pairs(spark, d).where((F.col("unreadable_mode") != "none") & SC.pattern_matches()).select("query_id", "candidate_id")


@query()
def score_full(spark, d):
    return SC.score(_pairs(spark, d)).select("query_id", "candidate_id", F.round("score", 6).alias("score"), F.array_join("signals", "|").alias("signals"), "raw", F.round("weighted", 6).alias("weighted"))


# --- Ranking, decisions (RK1-RK8, D1-D7, A5-A9). The SQL of the operators that
# --- order and group takes a plain scored table, made from the parts on both sides. ---

RANKED_SQL = f"""WITH {O.CATALOG.strip()}, s AS (SELECT CAST(p_size % 7 AS VARCHAR) AS query_id, candidate_id, name, base, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS score
  FROM cat JOIN part ON candidate_id = CAST(p_partkey AS VARCHAR))"""


def _toy_scored(spark, d) -> DataFrame:
    """A scored table with every column that ranking reads, its scores made up."""
    rows = prepared(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), "p_partkey", "p_size"), "candidate_id")
    return rows.withColumns({
        "query_id": (F.col("p_size") % 7).cast("string"), "score": ((F.col("p_partkey") * 37) % 1000).cast("double"), "qc": F.lit("ZZZZZ"), "unreadable_mode": F.lit("none"), "brand_like": F.lit(False),
        "result_limit": F.lit(5), "raw": F.lit(3), "weighted": F.lit(3.0), "head_raw": F.lit(3), "head_frame": F.lit(False), "head_variant": F.lit(False), "positional": F.lit(0.0), "edge": F.lit(0.0),
    })


@query(f"{RANKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, candidate_id) AS pos FROM s) SELECT query_id, candidate_id, CAST(pos AS INTEGER) AS pos FROM r")
def rank_by_score(spark, d):
    return R.promote(_toy_scored(spark, d)).select("query_id", "candidate_id", "pos")


@query(f"""{RANKED_SQL}, t AS (SELECT *, CAST(candidate_id AS INTEGER) % 4 AS raw, string_split(base, ' ')[1] AS family, length(replace(base, ' ', '')) AS n FROM s),
r AS (SELECT *, row_number() OVER w AS pos, first_value(raw) OVER w AS top_raw, first_value(score) OVER w AS top_score FROM t WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, name, candidate_id)),
c AS (SELECT *, pos > 1 AND top_raw <> 0 AND raw < top_raw AND raw <= 2 AND abs(5 - n) = raw AND top_score - score <= 120 AS corrects FROM r),
b AS (SELECT *, corrects AND row_number() OVER (PARTITION BY query_id ORDER BY corrects DESC, raw, score DESC, pos) = 1 AS front FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY front DESC, pos) AS pos2 FROM b),
l AS (SELECT *, first_value(raw) OVER v AS raw1, first_value(family) OVER v AS family1, first_value(base) OVER v AS base1 FROM p WINDOW v AS (PARTITION BY query_id ORDER BY pos2))
SELECT query_id, candidate_id, front, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos2 = 1 THEN 0 WHEN raw1 = 0 AND family = family1 AND base <> base1 THEN 1 ELSE 2 END, pos2) AS INTEGER) AS pos FROM l""")
def rank_promotion_lift(spark, d):
    rows = _toy_scored(spark, d).withColumns({"raw": (F.col("p_partkey") % 4).cast("int"), "weighted": (F.col("p_partkey") % 4).cast("double"), "brand_like": F.lit(True), "family_group_key": F.get(F.split("base_group_key", " "), F.lit(0))})
    plain = R.promote(rows.withColumn("brand_like", F.lit(False))).select("query_id", "candidate_id", F.col("pos").alias("was"))
    promoted = R.promote(rows)
    moved = promoted.select("query_id", "candidate_id", F.col("pos").alias("is")).join(plain, ["query_id", "candidate_id"]).select("query_id", "candidate_id", ((F.col("is") == 1) & (F.col("was") > 1)).alias("front"))
    return R.lift_family(promoted).join(moved, ["query_id", "candidate_id"]).select("query_id", "candidate_id", "front", "pos")


@query(f"""{RANKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, base ORDER BY score DESC, name, candidate_id) AS nth FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, candidate_id) AS rank FROM r WHERE nth = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, candidate_id, base AS base_group_key FROM k WHERE rank <= 5""")
def rank_top_k(spark, d):
    return R.rank(_toy_scored(spark, d)).select("query_id", "rank", "candidate_id", "base_group_key")


@query(f"""{RANKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, base ORDER BY score DESC, name, candidate_id) AS nth FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, candidate_id) AS rank FROM r WHERE nth = 1),
f AS (SELECT query_id, string_split(base, ' ')[1] AS family, base, rank FROM k WHERE rank <= 5)
SELECT query_id, family, CAST(min(rank) AS INTEGER) AS first_rank, count(*) AS n_variants, string_agg(base, '|' ORDER BY rank) AS variants FROM f GROUP BY ALL""")
def family_groups(spark, d):
    rows = R.rank(_toy_scored(spark, d)).withColumn("family_group_key", F.get(F.split("base_group_key", " "), F.lit(0)))
    return R.group_by_family(rows).select("query_id", "family", "first_rank", "n_variants", F.array_join("variants.base_group_key", "|").alias("variants"))


@query(f"""WITH {O.PREPARED.strip()}, {ANALYZED_SQL},
k AS (SELECT bc, c, ingc, route, unnest(list_distinct([substr(bc, 1, 1), substr(c, 1, 1)])) AS prefix FROM prep),
dg AS (SELECT prefix, count(DISTINCT bc) AS bases, count(DISTINCT c) AS products, count(DISTINCT ingc) AS ingredients, count(DISTINCT route) AS routes FROM k GROUP BY prefix),
sh AS (SELECT DISTINCT unnest([bc, c]) AS key FROM prep),
r AS (SELECT query_id, qc, coalesce(bases, 0) AS bases, coalesce(products, 0) AS products, coalesce(ingredients, 0) AS ingredients, coalesce(routes, 0) AS routes, length(qc) <= 4 AND qc IN (SELECT key FROM sh) AS exact_short
      FROM aq LEFT JOIN dg ON prefix = substr(qc, 1, 1))
SELECT query_id, bases, products, ingredients, routes, exact_short, NOT exact_short AND ((length(qc) <= 2 AND bases > 1) OR (length(qc) <= 4 AND (bases >= 4 OR ingredients >= 3)) OR bases >= 12 OR ingredients >= 6) AS force FROM r""")
def prefix_risk(spark, d):
    cat = Catalog(prepared(spark, d))
    return D.risk(analyze(asked(spark)), cat.danger, cat.registry)


@query(f"WITH {O.CATALOG.strip()}, f AS (SELECT DISTINCT route, reasons FROM cat) SELECT route, MAP({O.strings(D.ROUTE_LABELS)}, {O.strings(D.ROUTE_LABELS.values())})[route] AS label, reasons, MAP({O.strings(D.WARNING_LABELS)}, {O.strings(D.WARNING_LABELS.values())})[string_split(reasons, '|')[1]] AS warning FROM f WHERE reasons <> ''")
def labels_of_flags(spark, d):
    rows = part_catalog(spark, d).select(F.col("route_family").alias("route"), F.col("review_reasons").alias("reasons")).where("reasons <> ''").distinct()
    return rows.select("route", D.route_label(F.col("route")).alias("label"), "reasons", D.warning_label(F.get(F.split("reasons", r"\|"), F.lit(0))).alias("warning"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(D.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query()
def search_results(spark, d):
    """Exhaustive search: the canonical semantics."""
    return search_batch(Catalog(prepared(spark, d)), asked(spark), exhaustive=True).results


@query()
def search_blocked(spark, d):
    """The same by posting joins, as for large batches."""
    return search_batch(Catalog(stored(prepared(spark, d), "catalog")), asked(spark), exhaustive=False).results


@query()
def search_summary(spark, d):
    """Clarification and decision type of each query."""
    s = search_batch(Catalog(prepared(spark, d)), asked(spark), exhaustive=True).summary
    return s.select("query_id", "candidate_count", "needs_clarification", "decision_type", "unreadable_mode", "ending_fragment", "prefix_risk.*")


# --- Catalogue quality and evaluation (P1-P8, E1-E9) ---


@query(f"""WITH {O.CATALOG.strip()} SELECT candidate_id, upper(string_split(base, ' ')[1]) || ' ' || upper(string_split(base, ' ')[2]) AS base_key, regexp_extract(name, '[0-9]+ MG') AS strength0, form, coalesce({O.ROUTES}[form], 'unknown') AS route_of_form, ing AS ingredients, CAST(1 AS INTEGER) AS n_ingredients FROM cat""")
def catalog_fields(spark, d):
    text = F.concat("commercial_name_en", F.lit(" "), "detected_form_from_name")
    strength = F.regexp_replace(C.strengths("commercial_name_en"), "MG$", " MG").alias("strength0")
    ing = C.ingredients("ingredient_key")
    return part_catalog(spark, d).select("candidate_id", C.base_key(text).alias("base_key"), strength, C.form_of(text).alias("form"), C.route_family_of("detected_form_from_name").alias("route_of_form"), F.array_join(ing, "+").alias("ingredients"), F.size(ing).alias("n_ingredients"))


@query(f"""WITH {O.CATALOG.strip()}, n AS (SELECT *, count(*) OVER (PARTITION BY name) AS copies FROM cat)
SELECT candidate_id, concat_ws('|', CASE WHEN route = 'unknown' THEN 'UNKNOWN_ROUTE' END) AS flags, route = 'unknown' AS needs_review FROM n""")
def catalog_warnings(spark, d):
    return C.review(part_catalog(spark, d)).select("candidate_id", F.array_join("review_flags", "|").alias("flags"), "needs_review")


LABELS_SQL = "lab AS (SELECT DISTINCT query_id, base AS target_base, string_split(base, ' ')[2] AS target_ingredient FROM s WHERE score > 990)"
JUDGED_SQL = f"""{RANKED_SQL}, {LABELS_SQL}, one AS (SELECT query_id, min(target_base) AS target_base FROM lab GROUP BY query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, base ORDER BY score DESC, name, candidate_id) AS nth FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, candidate_id) AS rank FROM r WHERE nth = 1),
j AS (SELECT query_id, rank, CASE WHEN base = target_base THEN 2 WHEN string_split(base, ' ')[2] = string_split(target_base, ' ')[2] THEN 1 ELSE 0 END AS rel FROM k JOIN one USING (query_id) WHERE rank <= 5)"""


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    scored = _toy_scored(spark, d)
    best = scored.where("score > 990").groupBy("query_id").agg(F.min("base_group_key").alias("target_base"))
    labels = best.select("query_id", F.lit(None).cast("string").alias("target_candidate_id"), "target_base", F.get(F.split("target_base", " "), F.lit(1)).alias("target_ingredient"))
    return E.judge(R.rank(scored), labels), labels


@query(f"{JUDGED_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(rel AS INTEGER) AS relevance FROM j")
def judged_results(spark, d):
    return _judged(spark, d)[0].select("query_id", "rank", "relevance")


@query(f"""{JUDGED_SQL}, p AS (SELECT *, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM j),
m AS (SELECT query_id, max(CASE WHEN rel >= 2 AND rank <= 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) AS h5, coalesce(max(CASE WHEN rel >= 2 THEN 1 / rank END), 0) AS rr, coalesce(avg(CASE WHEN rel >= 2 THEN prec END), 0) AS ap,
      coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(best + 1)), 0), 0) AS nd FROM p GROUP BY query_id)
SELECT round(avg(h1), 6) AS hit_1, round(avg(h5), 6) AS hit_5, round(avg(h5), 6) AS hit_10, round(avg(h5), 6) AS hit_20, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(nd), 6) AS ndcg FROM m""")
def retrieval_metrics(spark, d):
    judged, labels = _judged(spark, d)
    m = E.metrics(E.per_query(judged, labels))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])
