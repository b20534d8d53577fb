"""SQL text for the registered queries: expressions in DuckDB's dialect, written
apart from the Column expressions that they check."""

from __future__ import annotations

from .functions.lexicon import ARABIC_FROM, ARABIC_TO, DIACRITICS, LEXICON, UNIT_SUFFIX, VOWELS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def table(pairs: dict[str, str]) -> str:
    return f"MAP({strings(pairs)}, {strings(pairs.values())})"


NOISE, GENERIC, CONTEXT = strings(LEXICON.noise), strings(LEXICON.generic), strings(LEXICON.context_noise)
ROUTES, ALIASES, CONFUSABLE, NEAR = table(LEXICON.routes), table(LEXICON.aliases), table(LEXICON.confusable), table(LEXICON.neighbours)


def norm(x: str) -> str:
    mapped = f"regexp_replace(translate(replace(coalesce({x}, ''), 'ß', 'ss'), '{ARABIC_FROM}', '{ARABIC_TO}'), '{DIACRITICS}', '', 'g')"
    return f"trim(regexp_replace(upper({mapped}), '[^0-9A-Z\\x{{0600}}-\\x{{06FF}}]+', ' ', 'g'))"


def squeeze(n: str) -> str:
    return f"replace({n}, ' ', '')"


def distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda e, ei: list_position({xs}, e) = ei)"


def joined(xs: str) -> str:
    return f"array_to_string({xs}, ' ')"


def sorted_set(xs: str) -> str:
    return joined(f"list_sort(list_distinct({xs}))")


def pieces(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: t <> '')"


def tokens(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: length(t) >= 2 AND NOT list_contains({NOISE}, t))"


def numbers(n: str) -> str:
    return f"list_filter(regexp_extract_all({n}, '[0-9A-Z_]+'), lambda t: regexp_full_match(t, '[0-9]+'))"


def routes(n: str) -> str:
    return f"list_filter(list_transform({pieces(n)}, lambda t: {ROUTES}[t]), lambda r: r IS NOT NULL)"


def unit(t: str) -> str:
    return f"(list_contains({CONTEXT}, {t}) OR regexp_matches({t}, '{UNIT_SUFFIX}'))"


def context(p: str) -> str:
    """``p``: a column that holds the words."""
    before, after = f"coalesce({p}[i - 1], '')", f"coalesce({p}[i + 1], '')"
    kept = f"list_filter({p}, lambda t, i: NOT ({unit('t')} OR (regexp_full_match(t, '[0-9]+') AND i > 1 AND (list_contains({CONTEXT}, {before}) OR {unit(after)}))))"
    return f"CASE WHEN len({p}) < 2 OR len({kept}) = 0 THEN {p} ELSE {kept} END"


def brands(c: str) -> str:
    """``c``: a column that holds the context words."""
    kept = f"list_filter({c}, lambda t: NOT list_contains({GENERIC}, t) AND NOT {unit('t')} AND length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+'))"
    return distinct(kept)


def head(p: str) -> str:
    return f"coalesce(list_filter({p}, lambda t: length(t) >= 3 AND NOT list_contains({GENERIC}, t))[1], {p}[1], '')"


def family(n: str) -> str:
    return f"regexp_replace({n}, '( ({'|'.join(LEXICON.qualifiers)}))+$', '')"


def _collapse(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 OR c <> string_split({x}, '')[i - 1]), '')"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def skeleton(x: str) -> str:
    return _collapse(_chain(x, ("PH", "F"), ("[CQK]", "K"), ("[PV]", "B"), ("[SZ]", "S"), (f"[{VOWELS}]", "")))


def phonetic(x: str) -> str:
    return _collapse(_chain(x, ("PH", "F"), ("CK", "K"), ("GH", "G"), ("[BPFV]", "P"), ("[DT]", "T"), ("[CGKQ]", "K"), ("[SZ]", "S"), ("J", "G"), (f"[{VOWELS}]", "")))


def ngrams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})))"


def drop_one(x: str, i: str = "i") -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda {i}: concat(substr({x}, 1, {i} - 1), substr({x}, {i} + 1)))"


def deletes(x: str, two: str) -> str:
    """One deletion, and a second where the condition ``two`` holds."""
    second = f"CASE WHEN {two} THEN flatten(list_transform({drop_one(x)}, lambda d: {drop_one('d', 'j')})) ELSE [] END"
    return f"list_distinct(list_concat([{x}], {drop_one(x)}, {second}))"


def visual(x: str) -> str:
    made = ", ".join(f"CASE WHEN contains({x}, {lit(a)}) THEN replace({x}, {lit(a)}, {lit(b)}) END" for a, b in LEXICON.lookalikes)
    return f"CASE WHEN length({x}) >= 3 THEN list_filter(list_distinct([{made}]), lambda v: v IS NOT NULL AND v <> {x}) ELSE [] END"


def confusable(a: str, b: str) -> str:
    return f"({b} <> '' AND contains(coalesce({CONFUSABLE}[substr({a}, 1, 1)], ''), substr({b}, 1, 1)))"


def keyboard(q: str, t: str) -> str:
    hits = f"len(list_filter(range(1, length({q}) + 1), lambda i: substr({q}, i, 1) = substr({t}, i, 1) OR coalesce(contains({NEAR}[substr({t}, i, 1)], substr({q}, i, 1)), false)))"
    return f"CASE WHEN length({q}) = length({t}) AND length({q}) BETWEEN 4 AND 18 THEN {hits} / length({q}) ELSE 0.0 END"


def _shared(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i)))"


def prefix_score(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN {_shared(a, b)} / greatest(length({a}), length({b})) ELSE 0.0 END"


def suffix_score(a: str, b: str) -> str:
    return prefix_score(f"reverse({a})", f"reverse({b})")


def position_score(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1))) / greatest(length({a}), length({b})) ELSE 0.0 END"


def coverage(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN least(length({a}), length({b})) / greatest(length({a}), length({b})) ELSE 0.0 END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def subsequence(q: str, t: str) -> str:
    """The earliest places of the characters in turn; the first place is the
    first occurrence of the first one."""
    step = f"CASE WHEN e < 0 THEN -1 WHEN strpos(substr({t}, e + 1), c) = 0 THEN -1 ELSE e + strpos(substr({t}, e + 1), c) END"
    end = f"list_reduce(list_transform(range(1, length({q}) + 1), lambda i: i), lambda e, k: {step.replace(', c)', f', substr({q}, k, 1))')}, 0)"
    span = f"({end} - strpos({t}, substr({q}, 1, 1)) + 1)"
    return f"CASE WHEN {q} <> '' AND {t} <> '' AND length({q}) <= length({t}) AND {end} > 0 THEN least(1.0, 0.6 * (length({q}) / {span}) + 0.4 * (length({q}) / length({t}))) ELSE 0.0 END"


#: The catalogue that the queries search, made from the part table.
CATALOG = """
cat AS (
  SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, p_name || ' ' || p_size || ' MG' AS name, upper(p_name) AS base, upper(string_split(p_name, ' ')[2]) AS ing,
         p_brand AS manufacturer, p_type AS drug_class, p_retailprice AS price,
         CASE p_type WHEN 'STANDARD' THEN 'oral_solid' WHEN 'MEDIUM' THEN 'oral_liquid' WHEN 'PROMO' THEN 'topical' WHEN 'LARGE' THEN 'injection' WHEN 'SMALL' THEN 'oral_solid' ELSE 'unknown' END AS route,
         CASE p_type WHEN 'STANDARD' THEN 'TABS' WHEN 'MEDIUM' THEN 'SYRUP' WHEN 'PROMO' THEN 'CREAM' WHEN 'LARGE' THEN 'VIAL' WHEN 'SMALL' THEN 'CAPS' ELSE '' END AS form,
         CASE WHEN p_size % 10 = 0 THEN 'CANCELLED' WHEN p_size % 7 = 0 THEN 'UNKNOWN_ROUTE|QUALITY_REVIEW' ELSE '' END AS reasons
  FROM part)"""

PREPARED = f"""{CATALOG},
p0 AS (SELECT *, {norm('name')} AS nn, {norm('base')} AS bn, {norm('ing')} AS ingn, {norm('manufacturer')} AS m_norm FROM cat),
p1 AS (SELECT *, {squeeze('nn')} AS c, {squeeze('bn')} AS bc, {squeeze('ingn')} AS ingc, {pieces('bn')} AS bp FROM p0),
p2 AS (SELECT *, {head('bp')} AS headc, {skeleton('bc')} AS sk, {phonetic('bc')} AS ph FROM p1),
fam AS (SELECT headc, m_norm FROM p2 WHERE length(headc) >= 5 AND m_norm <> '' GROUP BY ALL HAVING count(DISTINCT bc) >= 2),
prep AS (
  SELECT p2.*, fam.headc IS NOT NULL AS head_family, CASE WHEN fam.headc IS NOT NULL THEN p2.headc ELSE {family('bn')} END AS family_group_key
  FROM p2 LEFT JOIN fam USING (headc, m_norm))"""

#: Distinct plain words of the documents, and each against the words of the catalogue's names.
WORDS = f"""
w AS (SELECT DISTINCT unnest(regexp_extract_all(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[A-Z]+')) AS w FROM documents),
words AS (SELECT w FROM w WHERE length(w) BETWEEN 4 AND 18)"""
PAIRS = f"""{WORDS},
h AS (SELECT DISTINCT unnest(string_split(upper(p_name), ' ')) AS h FROM part),
pairs AS (SELECT w, h FROM words, h WHERE substr(w, 1, 1) = substr(h, 1, 1) AND abs(length(w) - length(h)) <= 2)"""

#: Unit and weighted restricted Damerau distances of ``pairs``: rows of the
#: dynamic programme by recursion, a row as a list, cell by cell.
OSA = f"""
cost AS (SELECT a, b, CASE WHEN a = b THEN 0.0 WHEN {confusable('a', 'b')} THEN 0.45 WHEN contains('{VOWELS}', a) AND contains('{VOWELS}', b) THEN 0.70 ELSE 1.0 END AS s
         FROM (SELECT chr(CAST(x AS INTEGER)) AS a FROM range(65, 91) t(x)), (SELECT chr(CAST(y AS INTEGER)) AS b FROM range(65, 91) t(y))),
costs AS (SELECT MAP(list(a || b), list(s)) AS m FROM cost),
kinds AS (SELECT k FROM (VALUES (false), (true)) t(k)),
dp AS (
  SELECT w, h, k, 0 AS i, [CAST(x AS DOUBLE) FOR x IN range(0, length(h) + 1)] AS cur, CAST([] AS DOUBLE[]) AS prev FROM pairs, kinds
  UNION ALL
  SELECT w, h, k, i + 1,
         list_reduce(range(1, length(h) + 1), lambda acc, j: list_append(acc, least(cur[j + 1] + 1, acc[j] + 1,
           cur[j] + CASE WHEN k THEN m[substr(w, i + 1, 1) || substr(h, j, 1)] WHEN substr(w, i + 1, 1) = substr(h, j, 1) THEN 0.0 ELSE 1.0 END,
           CASE WHEN i >= 1 AND j >= 2 AND substr(w, i + 1, 1) = substr(h, j - 1, 1) AND substr(w, i, 1) = substr(h, j, 1) THEN prev[j - 1] + CASE WHEN k THEN 0.55 ELSE 1.0 END ELSE 1e9 END)),
           [CAST(i + 1 AS DOUBLE)]),
         cur
  FROM dp, costs WHERE i < length(w)),
osa AS (SELECT w, h, max(CASE WHEN NOT k THEN cur[length(h) + 1] END) AS raw, max(CASE WHEN k THEN cur[length(h) + 1] END) AS weighted FROM dp WHERE i = length(w) GROUP BY ALL)"""
