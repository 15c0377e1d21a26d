"""Draws and samples against their definitions."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridmill.functions.rules import poisson
from gridmill.operators import choice as C
from gridmill.plans import choice_queries as Q
from gridmill.plans.views import table

SF = "/root/testdata/sf0.01"


def people(spark, n=400):
    return spark.range(n).select(
        F.col("id"), F.expr("array_distinct(filter(array(id % 11, id % 7 + 11, if(id % 5 = 0, 99, null)), x -> x is not null or id % 2 = 0))").alias("schools"), (F.col("id") % 4).alias("band"), F.floor(F.col("id") / 100).alias("age")
    )


def sample(df, n):
    return C.coverage_sample(df, "id", ["schools", "band", "age"], ["band", "age"], n, 8)


def test_coverage(spark):
    rows = {r.id: r for r in people(spark).collect()}
    got = sample(people(spark), 60).collect()
    assert len(got) == 60 == len({r.id for r in got})
    for c in ("band", "age"):
        assert {r[c] for r in got} == {r[c] for r in rows.values()}
    assert {s for r in got for s in r.schools if s is not None} == {s for r in rows.values() for s in r.schools if s is not None}
    forced = [r for r in got if r.covers_for]
    assert 11 <= len(forced) <= 11 + 7 + 1 + 4 + 4
    rest = Counter((r.band, r.age) for r in got if not r.covers_for)
    assert max(rest.values()) - min(rest.values()) <= 2  # strata of one size each


def test_greedy_order(spark):
    """Value after value, each that nobody taken has takes the first person by the order."""
    df = people(spark)
    rows = sorted(((r.u, r.id, r) for r in df.withColumn("u", F.xxhash64(F.lit(8), "id")).collect()), key=lambda x: x[:2])
    tags = {r.id: {(0, str(s)) for s in r.schools if s is not None} | {(1, str(r.band)), (2, str(r.age))} for _, _, r in rows}
    taken, seen = [], set()
    for tag in sorted(set().union(*tags.values())):
        if tag not in seen:
            who = next(i for _, i, _ in rows if tag in tags[i])
            taken.append(who)
            seen |= tags[who]
    assert {r.id for r in C.covering(df, "id", ["schools", "band", "age"], F.xxhash64(F.lit(8), F.col("id"))).collect()} == set(taken)
    few = sample(df, 3).collect()
    assert {r.id for r in few} == set(taken[:3])


def test_sample_ignores_partitions_and_small_tables(spark):
    df = people(spark)
    want = {r.id for r in sample(df, 60).collect()}
    assert {r.id for r in sample(df.repartition(17, "band"), 60).collect()} == want
    assert {r.id for r in sample(df.limit(20), 60).collect()} == {r.id for r in df.limit(20).collect()}
    assert sample(df.where("id < 0"), 60).count() == 0


def test_stratum_is_cut_before_the_shuffle(spark):
    plan = C.stratified_sample(people(spark), "band", "id", 9, 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_forced_first_then_by_weight(spark):
    rows = table(spark, SF, "households")
    n = rows.count() * 3 // 5
    got = Q.weighted_sample_without_replacement(spark, SF).collect()
    cars = {r.household_id: r.vehicles for r in rows.collect()}
    forced = sorted(h for h, v in cars.items() if v == 0)
    assert len(got) == n == len({r.household_id for r in got}) and {r.household_id for r in got} >= set(forced[:n])
    u = {r.household_id: r.u for r in rows.select("household_id", C.uniform("sample", 3, F.col("household_id")).alias("u")).collect()}
    order = sorted((h for h in cars if cars[h]), key=lambda h: -math.log(u[h]) / cars[h])
    assert {r.household_id for r in got} == set(forced) | set(order[: n - len(forced)])
    few = C.weighted_sample(rows, "household_id", F.col("vehicles"), 5, 3, F.col("vehicles") == 0).collect()
    assert sorted(r.household_id for r in few) == forced[:5]


def test_slots_and_overflow(spark):
    got = Q.slots_without_replacement(spark, SF).collect()
    schools = {r.school_id: r.curb_spots for r in table(spark, SF, "schools").collect()}
    n = table(spark, SF, "households").count()
    assert len(got) == n and len({(r.building_id, r.slot) for r in got if r.slot}) == sum(v // 2 for v in schools.values()) < n
    assert all(1 <= r.slot <= schools[r.building_id] // 2 for r in got if r.slot)
    few = C.slots(spark.createDataFrame([(1, 3), (2, 0), (3, 4)], "building_id long, capacity int"), 5, 1).collect()
    assert len({(r.building_id, r.slot) for r in few}) == 5 and {r.building_id for r in few} <= {1, 3}
    assert C.slots(spark.createDataFrame([(1, 0, 1)], "building_id long, capacity int, weight int"), 5, 1, "weight").count() == 0


def test_draws_with_replacement(spark):
    weights = {k: float(w) for k, w in enumerate([0, 1, 2, 4, 0, 8, 1000, 1, 0, 50])}
    rows = spark.createDataFrame(list(weights.items()), "k long, w double")
    got = {r.draw: r.k for r in C.drawn_with_replacement(rows, "k", "w", 20_000, 4).collect()}
    at = {r.id: r.u * sum(weights.values()) for r in spark.range(20_000).select("id", C.uniform("replace", 4, F.col("id")).alias("u")).collect()}
    total, want = 0.0, {}
    for k, w in weights.items():
        want |= {d: k for d, x in at.items() if total <= x < total + w}
        total += w
    assert got == want
    assert {r.draw: r.k for r in C.drawn_with_replacement(rows.repartition(5), "k", "w", 20_000, 4).collect()} == got


def test_category_draw(spark):
    got = Q.weighted_category_draw(spark, SF).collect()
    u = {r.person_id: r.u for r in table(spark, SF, "persons").select("person_id", C.uniform("job", 1, F.col("person_id")).alias("u")).collect()}
    assert len(got) == len(u)
    for r in got:
        assert r.job == ("office" if u[r.person_id] < 0.5 else "shop" if u[r.person_id] < 0.8 else "home")


@pytest.mark.parametrize("rate", [0.0, 0.3, 7.5, 80.0, 1200.0, 20000.0])
def test_poisson_of_any_rate(spark, rate):
    us = [1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    got = [r.k for r in spark.createDataFrame([(u,) for u in us], "u double").select(poisson(F.col("u"), F.lit(rate)).alias("k")).collect()]

    def cdf(k):
        return math.fsum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1)) if rate else 1.0

    for u, k in zip(us, got):
        assert cdf(k) >= u - 1e-9 and (k == 0 or cdf(k - 1) <= u + 1e-9)


def test_poisson_query(spark):
    from gridmill.plans.rule_queries import poisson_counts

    assert {r.node_id for r in poisson_counts(spark, SF).collect()} == {r.node_id for r in table(spark, SF, "nodes").collect()}
