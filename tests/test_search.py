"""The whole search on small catalogues."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators.query import analyze
from lodestar.plans.search import Catalog, pair, search, search_batch
from lodestar.sources import catalog as C

COLUMNS = "id string, n string, ar string, b string, ing string, r string, m string, w string"
PANADOL = ("1", "PANADOL 500 MG 24 TABS", "بنادول", "PANADOL", "PARACETAMOL", "oral_solid", "ACME", "")


def catalog(spark, *rows) -> Catalog:
    full = [tuple(r) + ("",) * (8 - len(r)) for r in rows]
    return Catalog.build(C.canonical(spark.createDataFrame(full, COLUMNS)))


def rows(answer):
    return sorted((r.asDict() for r in answer.results.collect()), key=lambda r: (r["query_id"], r["rank"]))


def test_published_example(spark):
    answer = search(spark, catalog(spark, PANADOL), "PANADL")
    (r,) = rows(answer)
    assert (r["score"], r["raw_edit_distance"], r["weighted_edit_distance"], r["positional_evidence"], r["edge_evidence"], r["needs_clarification"]) == (6033, 1, 1.0, 0.714, 0.714, False)
    assert r["matched_signals"] == (
        "algorithm4_family_rescue|algorithm4_phonetic_family|algorithm4_position_overlap|algorithm4_skeleton_family|algorithm4_weighted_confusion_edit|"
        "drug_phonetic_key|fuzzy_base_ed1|heard_spelling_alias|phonetic_first_char|phonetic_skeleton"
    )
    assert answer.summary.first()["decision_type"] == "ranked_matches"


def test_one_row_a_base_and_limit(spark):
    cat = catalog(spark, PANADOL, ("2", "PANADOL 1 GM", "", "PANADOL"), ("3", "PANADOL COLD", "", "PANADOL COLD"), ("4", "PANADOX", "", "PANADOX"))
    found = rows(search(spark, cat, "panadol"))
    bases = [r["base_group_key"] for r in found]
    assert len(bases) == len(set(bases)) == 3 and bases[0] == "PANADOL"
    assert [r["rank"] for r in rows(search(spark, cat, "panadol", limit=2))] == [1, 2]


def test_family_lift(spark):
    cat = catalog(spark, ("1", "ALPHA 5 MG", "", "ALPHA"), ("2", "ALPHA EXTRA", "", "ALPHA EXTRA"), ("3", "ALPHAS", "", "ALPHAS"), ("4", "ALPHAB ALPHA", "", "ALPHAB ALPHA"))
    answer = search(spark, cat, "alpha")
    assert [r["base_group_key"] for r in rows(answer)][:2] == ["ALPHA", "ALPHA EXTRA"]
    assert answer.summary.first()["decision_type"] == "family_variant_selection"


@pytest.mark.parametrize(("text", "mode", "ending", "want"), [("pana", "after", "", {"PANADOL", "PANAX"}), ("dol", "before", "", {"PANADOL"}), ("pan", "middle", "dol", {"PANADOL"}), ("pan", "middle", "", set())])
def test_unreadable(spark, text, mode, ending, want):
    cat = catalog(spark, PANADOL, ("2", "PANAX", "", "PANAX"), ("3", "PANA", "", "PANA"))
    answer = search(spark, cat, text, mode=mode, ending=ending)
    found = rows(answer)
    assert {r["base_group_key"] for r in found} == want
    assert all(r["needs_clarification"] and f"known_unreadable_{mode}" in r["matched_signals"] for r in found)
    assert answer.summary.first()["decision_type"] == f"unreadable_{mode}_matches"


def test_short_zero_warning_generic(spark):
    cat = catalog(spark, PANADOL, ("2", "CALCIUM", "", "CALCIUM", "", "", "", "CANCELLED"), ("3", "SKIN CREAM", "", "SKIN CREAM"))
    asked = C.queries_frame(spark, ["CA", "ZZZZ", "calcium", "cream", ""])
    answer = search_batch(cat, asked)
    found, summary = rows(answer), {r["query_id"]: r for r in answer.summary.collect()}
    by = lambda q: [r for r in found if r["query_id"] == q]
    assert by("0") and all(r["needs_clarification"] for r in by("0"))
    assert not by("1") and summary["1"]["decision_type"] == "ranked_matches"
    assert by("2")[0]["warnings"] == "CANCELLED" and by("2")[0]["needs_clarification"] and "quality_status_penalty" in by("2")[0]["matched_signals"]
    assert by("3") and by("3")[0]["needs_clarification"]
    assert "4" not in summary  # blank queries have no row


def test_promotion_prefers_the_nearer_spelling(spark):
    cat = catalog(spark, ("1", "LIPITORAX FORTE", "", "LIPITORAX FORTE"), ("2", "LIPITOR", "", "LIPITOR"), ("3", "LIPTONAL", "", "LIPTONAL"))
    assert rows(search(spark, cat, "lipitr"))[0]["base_group_key"] == "LIPITOR"


def test_blocking_is_a_subset_with_the_same_scores(spark):
    bases = ["PANADOL", "PANADOL EXTRA", "AUGMENTIN", "NEXIUM", "LIPITOR", "BRUFEN", "VOLTAREN", "KETOFAN", "CALCIMATE", "ASPOCID"]
    cat = catalog(spark, *[(str(i), f"{b} {i} MG", "", b, "", "oral_solid", "ACME") for i, b in enumerate(bases)])
    asked = C.queries_frame(spark, ["panadl extra", "ogmentin", "neksium 4 mg", "brofen", "voltarin tabs", "aspocd"])
    full = {(r["query_id"], r["candidate_id"]): r["score"] for r in rows(search_batch(cat, asked, exhaustive=True))}
    blocked = {(r["query_id"], r["candidate_id"]): r["score"] for r in rows(search_batch(cat, asked, exhaustive=False))}
    assert blocked.items() <= full.items()
    best = lambda d: {q: max((s, c) for (x, c), s in d.items() if x == q) for q in {x for x, _ in d}}
    assert best(full) == best(blocked)


def test_requests_and_readers(spark, tmp_path):
    q = C.queries_frame(spark, ["a", {"query": "b", "unreadableContinuation": True}, {"text": "c", "unreadable_mode": "Before", "endingFragment": "z", "limit": 3}]).collect()
    assert [tuple(r)[1:] for r in q] == [("a", "none", "", 20), ("b", "after", "", 20), ("c", "before", "z", 3)]
    (tmp_path / "c.json").write_text('{"records": [{"id": "1", "n": "PANADOL", "b": "PANADOL", "p": 12.5, "bv": 3, "w": "A|B"}, {"id": "2"}]}')
    got = C.prepare_catalog(C.read_json(spark, str(tmp_path / "c.json"))).orderBy("candidate_id").collect()
    assert (got[0]["bc"], float(got[0]["price_egp"]), got[0]["base_variant_count"], got[0]["warning_flags"]) == ("PANADOL", 12.5, 3, ["A", "B"])
    assert got[1]["bc"] == "" and got[1]["nn"] == ""
    (tmp_path / "c.csv").write_text("candidate_id,commercial_name_en,base_group_key,review_reasons\n1,PANADOL,PANADOL,A;B\n")
    assert C.prepare_catalog(C.read_csv(spark, str(tmp_path / "c.csv"))).first()["warning_flags"] == ["A", "B"]
    search(spark, catalog(spark, PANADOL), "panadol").write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 1


def test_catalog_preparation(spark):
    df = spark.createDataFrame([("Augmentin 1.5% Cream 30 mg 24 tabs", "A + b;C", "ACME > HOLD", "x.y")], "n string, i string, m string, c string")
    primary, parent = C.manufacturer_chain("m")
    r = df.select(C.base_key("n").alias("base"), C.strengths("n").alias("st"), C.packages("n").alias("pk"), C.form_of("n").alias("f"), C.route_family_of("n").alias("r"), C.ingredients("i").alias("i"), primary.alias("p"), parent.alias("q"), C.class_top("c").alias("c")).first()
    assert tuple(r) == ("AUGMENTIN", "1.5%|30MG", "24 TABS", "CREAM", "topical", ["A", "B", "C"], "ACME", "HOLD", "x")


def test_review_flags(spark):
    rows_ = [("1", "X 5 MG", "X", "I", "oral_solid", "M", "C", 10.0)] * 1 + [(str(i), f"N{i}", f"N{i}", "I", "topical", "M", "C", 10.0 + i / 10) for i in range(2, 30)]
    rows_ += [("40", "DEAR", "DEAR", "I", "topical", "M", "C", 9000.0), ("41", "SAME", "S1", "I", "topical", "M", "C", 10.0), ("42", "SAME", "S2", "I", "topical", "M", "C", 10.0), ("43", "Z CREAM", "Z", None, "oral_solid", None, None, None)]
    df = C.canonical(spark.createDataFrame(rows_, "id string, n string, b string, ing string, r string, m string, dc string, p double"))
    flags = {r["candidate_id"]: r["review_flags"] for r in C.review(df).collect()}
    assert flags["1"] == [] and flags["40"] == ["PRICE_OUTLIER"] and flags["41"] == flags["42"] == ["DUPLICATE_OR_CONFLICT"]
    assert flags["43"] == ["MISSING_COMPOSITION", "MISSING_MANUFACTURER", "MISSING_CLASS", "ROUTE_CONFLICT"]


def test_search_is_planned_with_one_broadcast_of_the_queries(spark):
    cat = catalog(spark, PANADOL)
    plan = pair(cat, analyze(C.queries_frame(spark, ["x y"])), True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan


def test_empty_catalog(spark):
    empty = Catalog.build(C.canonical(spark.createDataFrame([], COLUMNS)))
    answer = search_batch(empty, C.queries_frame(spark, ["panadol"]))
    assert answer.results.count() == 0 and answer.summary.first()["candidate_count"] == 0
    assert empty.postings.where(F.col("key") == "").count() == 0


def test_stream_of_requests(spark, tmp_path):
    from lodestar.streaming.search import REQUESTS, search_stream

    C.queries_frame(spark, ["panadl", "panadol"]).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).json(str(tmp_path / "in"))
    running = search_stream(catalog(spark, PANADOL), stream, str(tmp_path / "out")).trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/results"))
    assert {(r["query_id"], r["candidate_id"]) for r in got.collect()} == {("0", "1"), ("1", "1")}


def test_a_batch_of_several_blocks_is_scored_in_full(spark, monkeypatch):
    cat = catalog(spark, PANADOL, ("2", "CALCIUM", "", "CALCIUM"), ("3", "SKIN CREAM", "", "SKIN CREAM"), ("4", "LIPITOR", "", "LIPITOR"))
    asked = C.queries_frame(spark, ["PANADL", "calcim", "lipitr", "skin", "ZZZZ"])
    whole = search_batch(cat, asked, exhaustive=True)
    want, summary = rows(whole), sorted(whole.summary.collect())
    monkeypatch.setattr("lodestar.plans.search.EXHAUSTIVE_QUERIES", 2)
    blocks = search_batch(cat, asked)
    assert rows(blocks) == want and sorted(blocks.summary.collect()) == summary
    assert {r["candidate_count"] for r in summary} == {4}
