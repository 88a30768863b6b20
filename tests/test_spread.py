"""Work that no single task may hold: pairs of a group, pixels of images, the guard around held-out frames."""

from lanepulse.operators import dataset as D
from lanepulse.operators import groups as G
from lanepulse.operators import pixels as P
from lanepulse.plans import dataset_queries as Q


def test_scenario_of_one_group_is_spread(spark):
    stats = spark.range(300).selectExpr("1L AS group_id", "id AS camera_id", "id / 300D AS mean")
    plan = G.scenario(stats, [0.1], [1.0])
    assert plan.count() == 300 * 299
    # both sides by group and part, in a number of partitions that stays
    assert plan._jdf.queryExecution().executedPlan().toString().count("256), REPARTITION_BY_NUM") >= 2


def test_parts_of_pixels_grow(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 50)
    rows = spark.range(1000).selectExpr("id % 100 AS image", "id AS pixel", "1D AS conf")
    out = P.area_error(rows, rows.select("image", "pixel"), spark.range(100).selectExpr("id AS image", "10D AS px"), [0.5])
    assert {(r.iou, r.error, r.true_ratio) for r in out.collect()} == {(1.0, 0.0, 100.0)}
    assert "hashpartitioning(image#" in out._jdf.queryExecution().toString() and ", 41)" in out._jdf.queryExecution().toString()


def test_risk_looks_at_a_frame_once(spark):
    rows = spark.range(300).selectExpr("1 AS clip", "id AS image_id", "id div 2 AS frame", "id IN (40, 41, 200) AS held").localCheckpoint()
    out = D.leak_risk(rows, 10)
    held = [40, 41, 200]
    want = {i: -1 if i in held else 2 if min(abs(i - h) for h in held) <= 10 else 1 for i in range(300)}
    assert {r.image_id: r.risk for r in out.collect()} == want
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString()


def test_manifest_rows_are_spread(spark, data, monkeypatch):
    monkeypatch.setattr(Q, "TASK_ROWS", 100)
    rows = Q.conditioned(spark, data)
    n = rows.count()
    assert rows.rdd.getNumPartitions() == n // 100 + 1
