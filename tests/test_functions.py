"""Goldens of the scalar functions, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import keys as K
from lodestar.functions import normalize as N
from lodestar.functions import similarity as S


def column(spark, values, f, type="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NORMS = {
    "augmentin 1 gm tabs": ("AUGMENTIN 1 GM TABS", ["1"]), "ogmentin 625": ("OGMENTIN 625", ["625"]), "bandol cold": ("BANDOL COLD", []), "اوجمنتين 1 جم": ("اوجمنتين 1 جم", ["1"]), "ليبتور ٨٠": ("ليبتور 80", ["80"]),
    "data-version": ("DATA VERSION", []), "CA": ("CA", []), "1.5% cream": ("1 5 CREAM", ["1", "5"]), "500MG": ("500MG", []), "1جم": ("1جم", ["1"]), "أُمبولـة": ("امبوله", []), "straße é": ("STRASSE", []), "": ("", []), None: ("", []),
}


def test_normalize(spark):
    assert column(spark, NORMS, N.norm) == [n for n, _ in NORMS.values()]
    assert column(spark, NORMS, N.compact) == [n.replace(" ", "") for n, _ in NORMS.values()]
    assert column(spark, NORMS, lambda v: N.numbers(N.norm(v))) == [x for _, x in NORMS.values()]


def test_normalize_is_idempotent(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB9 -٣ةأـßé.%") for _ in range(rng.randrange(30))) for _ in range(300)]
    once = column(spark, texts, N.norm)
    assert column(spark, once, N.norm) == once


def test_tokens_and_routes(spark):
    normed = lambda f: lambda v: f(N.norm(v))
    assert column(spark, ["augmentin 1 gm tabs", "ليبتور ٨٠", "a bb bb and", None], normed(N.tokens)) == [["AUGMENTIN"], ["ليبتور", "80"], ["BB", "BB"], []]
    assert column(spark, ["augmentin 1 gm tabs", "x eye tab", ""], normed(N.route_hints)) == [["oral_solid"], ["ophthalmic", "oral_solid"], []]
    assert column(spark, ["vitamin c 500 mg tabs", "10 mg", "syrup", "500mg x 5"], normed(N.context_tokens)) == [["VITAMIN", "C"], ["10"], ["SYRUP"], ["X", "5"]]
    assert column(spark, ["new ab panadol 500 panadol", "new"], normed(N.brand_compacts)) == [["PANADOL"], []]
    assert column(spark, ["new panadol", "ab cd", ""], normed(N.brand_head)) == ["PANADOL", "AB", ""]
    assert column(spark, ["panadol extra plus", "plus extra", "extra"], normed(N.family_key)) == ["PANADOL", "PLUS", "EXTRA"]
    assert column(spark, ["A | B||", "A;B", None], N.warning_list) == [["A", "B"], ["A", "B"], []]


def test_keys(spark):
    values = ["PANADOL", "BANDOL", "PANADL", "AUGMENTIN", "OGMENTIN", "NEXIUM", "NEKSIUM", "PHARMA", "JUICEGUIDE", "BANANA", "CHUCK"]
    assert column(spark, values, K.skeleton) == ["BNDL", "BNDL", "BNDL", "GMNTN", "GMNTN", "NXM", "NKSM", "FRM", "JKGD", "BN", "KHK"]
    assert column(spark, values, K.phonetic) == ["PNTL", "PNTL", "PNTL", "KMNTN", "KMNTN", "NXM", "NKSM", "PRM", "GKT", "PN", "KHK"]
    assert sorted(column(spark, ["ABC"], lambda v: K.deletes(v, 2))[0]) == ["A", "AB", "ABC", "AC", "B", "BC", "C"]
    assert column(spark, ["AB", "ABAB"], lambda v: K.ngrams(v, 3)) == [[], ["ABA", "BAB"]]
    assert column(spark, ["RN1", "AB"], K.visual_variants) == [["M1", "RRI1", "RNI", "RNL"], []]
    assert column(spark, ["PAN", "XY", ""], K.first_letter_variants) == [["BAN"], [], []]
    assert column(spark, ["ABCD"], lambda v: K.suffix_keys(v)) == [["DCB", "DCBA"]]


PAIRS = [
    ("BANDOL", "PANADOL", 2, 1.45, 0, 0.428571, 0.285714, 0.125, 0), ("PANADL", "PANADOL", 1, 1, 0.714286, 0.142857, 0.714286, 0.5, 0.857143), ("OGMENTIN", "AUGMENTIN", 2, 1.45, 0, 0.777778, 0, 0.625, 0),
    ("NEKSIUM", "NEXIUM", 2, 2, 0.285714, 0.428571, 0.285714, 0.125, 0), ("LEPITOR", "LIPITOR", 1, 0.45, 0.142857, 0.714286, 0.857143, 0.428571, 0), ("CA", "ABC", 3, 3, 0, 0, 0, 0, 0), ("AB", "BA", 1, 0.55, 0, 0, 0, 0, 0), ("", "ABC", 3, 3, 0, 0, 0, 0, 0),
]


def test_similarity_goldens(spark):
    df = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(PAIRS)], "i int, a string, b string").withColumn("d", S.osa("a", "b"))
    got = df.orderBy("i").select("d.raw", "d.weighted", S.prefix_score("a", "b"), S.suffix_score("a", "b"), S.position_score("a", "b"), S.jaccard(K.ngrams("a", 3), K.ngrams("b", 3)), S.subsequence_score("a", "b")).collect()
    for row, p in zip(got, PAIRS, strict=True):
        assert list(row) == pytest.approx(list(p[2:]), abs=1e-6)


def test_rescue_goldens(spark):
    pairs = [("PANADL", 2.455714), ("BANDOL", 1.637643), ("PANA", 0.843429), ("XYLOFON", 0.096)]
    df = spark.createDataFrame([(a, "PANADOL", x) for a, x in pairs] + [("OGMENTIN", "AUGMENTIN", 1.699833)], "a string, b string, want double").withColumn("d", S.osa("a", "b"))
    df = df.withColumn("m", F.struct(*[v.alias(k) for k, v in S.rescue_parts("a", "b", F.col("d.raw"), F.col("d.weighted")).items()]))
    for r in df.select("want", S.rescue_score("a", "b", F.col("m")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6)


def test_osa_properties(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABEIOT") for _ in range(rng.randrange(12)))
    rows = [(word(), word()) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", S.osa("a", "b").alias("x"), S.osa("b", "a").alias("y"), F.levenshtein("a", "b").alias("lev")).collect():
        assert r["x"]["raw"] == r["y"]["raw"] and r["x"]["weighted"] == pytest.approx(r["y"]["weighted"])
        assert abs(len(r["a"]) - len(r["b"])) <= r["x"]["raw"] <= r["lev"]
        assert r["x"]["weighted"] <= r["x"]["raw"] + 1e-9
