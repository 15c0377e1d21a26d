"""What stands in many cells is never broadcast: Spark takes it for as small as before its rows were multiplied."""

import math

import pytest
from pyspark.sql import functions as F

from gridmill.operators import spatial as S
from gridmill.operators import world as Wo


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan, "cell_x" in plan and "SortMergeJoin" in plan


@pytest.fixture
def points(spark):
    return spark.range(200).select("id", (F.col("id") % 20 * 10.0).alias("x"), F.floor(F.col("id") / 20).cast("double").alias("z"))


def test_within(spark, points):
    other = points.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("z").alias("z2"))
    assert joins(S.within(points, other, 15.0)) == (False, True)


def test_rings(spark, points):
    rings = points.select(F.col("id").alias("ring_id"), S.box_ring(F.col("x"), F.col("z"), F.col("x") + 5, F.col("z") + 5).alias("ring"))
    assert joins(Wo.near_rings(points.select("id", F.col("x").alias("x2"), F.col("z").alias("z2")), rings, 9.0)) == (False, True)
    assert joins(S.points_in_polygons(points, rings, 20.0)) == (False, True)


def test_segments(spark, points):
    lines = points.select(F.col("id").alias("edge_idx"), F.col("x").alias("x0"), F.col("z").alias("z0"), (F.col("x") + 9).alias("x1"), F.col("z").alias("z1"), F.lit(4.0).alias("reach"))
    assert joins(S.within_segments(points, lines, 4.0)) == (False, True)


def test_far_points_meet_few_targets(spark, monkeypatch):
    """All points lie far from all targets: exact, and without a meeting of each with each."""
    at = lambda i: (i * 37 % 400 * 5.0, i * 53 % 300 * 5.0)
    places = [(i, *at(i), i % 2) for i in range(300)]
    others = [(i, at(i)[0] + 90_000.0, at(i)[1] - 40_000.0, i % 3) for i in range(3000)]
    points = spark.createDataFrame(places, "id long, x double, z double, g long")
    targets = spark.createDataFrame(others, "id2 long, x2 double, z2 double, g long")
    for on in ([], ["g"]):
        near = {p[0]: min(((round(math.dist(p[1:3], t[1:3]), 6), t[0]) for t in others if not on or t[3] == p[3]))[1] for p in places}
        got = S.nearest(points, targets if on else targets.drop("g"), "id", "id2", 10.0, on=on, digits=6)
        assert {r.id: r.id2 for r in got.collect()} == near
    calls, within = [], S.within
    monkeypatch.setattr(S, "within", lambda *a: calls.append(a[2]) or within(*a))
    S.nearest(points, targets.drop("g"), "id", "id2", 10.0, digits=6)
    assert max(calls) <= 40.0
