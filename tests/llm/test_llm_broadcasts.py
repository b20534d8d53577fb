"""What the near-duplicate joins may broadcast."""

from lodestar.llm import near_dup


def test_visitors_of_anchors_are_not_broadcast(spark):
    classes = spark.range(200).selectExpr("xxhash64(id) fp", "id rep")
    plan = near_dup.links(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_visitors_of_full_anchors_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "MOST_RESIDENTS", 1)
    classes = spark.range(64).selectExpr("shiftleft(id, 46) fp", "id rep")
    found = near_dup.links(classes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and not any("bit_count" in x for x in plan.split("\n") if "BroadcastHashJoin" in x)
    near = {(a, b) for a in range(64) for b in range(a + 1, 64) if bin(a ^ b).count("1") <= 2}
    assert {tuple(r) for r in found.collect()} == near
