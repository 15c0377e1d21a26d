"""Running sums and caps over groups that no task holds whole."""

import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import choice as C
from gridmill.operators import network as N
from gridmill.operators import tables as T


@pytest.fixture(autouse=True)
def spread(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sum_splits_a_hot_group(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(None if draw.random() < 0.1 else "hot" if draw.random() < 0.8 else f"g{draw.randint(0, 3)}", draw.randint(0, 50), i, None if draw.random() < 0.1 else draw.randint(-5, 9)) for i in range(20_000)]
    placed, real = [], N.kept
    monkeypatch.setattr(N, "kept", lambda df: placed.append(real(df)) or placed[-1])
    df = spark.createDataFrame(rows, "g string, t int, id int, v int")
    got = {r.id: r.s for r in T.running_sum(df, ["g"], [F.desc("t"), "id"], F.col("v"), "s").collect()}
    want, so_far = {}, {}
    for g, t, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        so_far[g] = so_far.get(g, 0) + (v or 0)
        want[i] = so_far[g]
    assert got == want
    most = placed[0].groupBy("__part").count().agg(F.max("count")).first()[0]
    assert most < 8_000 and placed[0].where("g = 'hot'").select("__part").distinct().count() > 3
    assert T.running_sum(df.limit(0), ["g"], ["t", "id"], F.col("v"), "s").count() == 0


def test_caps(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), draw.choice(["bus", "car", None]), draw.choice(["car", "bus"]), "walk", float(draw.randint(0, 9))) for i in range(600)]
    members = spark.createDataFrame(rows, "person_id long, area string, choice string, base string, alternative string, margin double")
    order = sorted(rows, key=lambda r: (-r[5], r[0]))
    taken, want = {}, {}
    for i, area, choice, _, alternative, _ in order:
        if choice == "bus":
            taken[area] = taken.get(area, 0) + 1
        want[i] = alternative if choice == "bus" and taken[area] > 20 else choice
    assert {r.person_id: r.choice for r in C.cap_rechoose(members, ["area"], "bus", 20).collect()} == want
    size = {a: sum(r[1] == a for r in rows) for a in ("a", "b", None)}
    taken, want = {}, {}
    for i, area, choice, base, _, _ in order:
        switched = choice == "bus" and base != "bus"
        taken[area] = taken.get(area, 0) + switched
        want[i] = base if switched and taken[area] > size[area] // 10 else choice
    assert {r.person_id: r.choice for r in C.cap_adoption(members, ["area"], "bus", 0.1).collect()} == want
