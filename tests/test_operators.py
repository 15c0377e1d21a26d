import pytest
from pyspark.sql import functions as F

from gridmill.functions import scalars as S
from gridmill.operators import choice as C
from gridmill.operators import network as N
from gridmill.operators import queues as Q
from gridmill.operators import report as R
from gridmill.operators import state as St


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_three_cars_wait_in_line(spark):
    cars = spark.createDataFrame([(i, 0.0) for i in range(3)], "id long, at double").withColumn("q", F.lit(1))
    waits = [r.wait for r in Q.fluid_queue(cars, ["q"], ["at", "id"], "at", F.lit(10)).orderBy("id").collect()]
    assert waits == [0.0, 10.0, 20.0]


def test_half_weight_cars(spark):
    cars = spark.createDataFrame([(i, 0.0) for i in range(10)], "id long, at double").withColumn("q", F.lit(1))
    assert max(r.begin for r in Q.fluid_queue(cars, ["q"], ["at", "id"], "at", F.lit(0.5 * 10)).collect()) == 45.0


def test_balking(spark):
    cars = spark.createDataFrame([(i, float(i), 10.0, 12.0, 1) for i in range(5)], "id long, at double, s double, patience double, q int")
    got = Q.queue_with_balking(cars, ["q"], "at", "s", "patience", ["at", "id"]).orderBy("id").collect()
    assert [(r.wait, r.balked) for r in got] == [(0.0, False), (9.0, False), (None, True), (None, True), (None, True)]


def test_empty_summary_is_zero(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0), ("b", 2.0)], "g string, v double")
    got = {r.g: (r.v_median, r.v_p10, r.v_p90) for r in R.median_p10_p90(df, "v", ["g"]).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (1.5, 1.1, 1.9)}


def test_strict_pairs(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "seed int, m double"), spark.createDataFrame([(2, 2.0)], "seed int, m double")
    with pytest.raises(Exception, match="partner"):
        R.paired(a, b, ["seed"]).collect()
    assert R.paired(a, b, ["seed"], strict=False).count() == 0


def test_one_sided_trips_count_as_zero(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 2, float("nan"))], "seed int, person_id long, m double")
    b = spark.createDataFrame([(1, 3, 4.0), (1, 2, float("nan"))], "seed int, person_id long, m double")
    assert {r.person_id: r.change for r in R.person_changes(a, b, "m").collect()} == {1: -5.0, 3: 4.0}


def test_votes(spark):
    votes = spark.createDataFrame([(1, 7, 1, 1, 1), (1, 7, 0, 2, 2), (1, 8, -1, 1, 3), (2, 8, 1, 1, 4)], "plan_id int, player_id int, value int, ts int, event_id int")
    plans = spark.createDataFrame([(1,), (2,), (3,)], "plan_id int")
    assert {r.plan_id: r.votes for r in St.vote_totals(plans, votes).collect()} == {1: -1, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        St.list_plans(plans, "colour", 1)


def test_fingerprint_ignores_order_not_copies(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    assert St.fingerprint(a).first() == St.fingerprint(a.orderBy(F.desc("k")).repartition(3)).first()
    assert St.fingerprint(a).first() != St.fingerprint(a.distinct()).first()


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200)
    draw = lambda d: {r.id: r.u for r in d.select("id", C.uniform("s", 3, F.col("id")).alias("u")).collect()}
    assert draw(df) == draw(df.repartition(7)) and 0.4 < sum(draw(df).values()) / 200 < 0.6


def test_weights_to_bytes(spark):
    assert one(spark, S.weights_to_bytes([F.lit(1.0), F.lit(1.0), F.lit(1.0)])) == [85, 85, 85]
    assert one(spark, S.weights_to_bytes([F.lit(0.0), F.lit(0.0)])) == [0, 255]
    assert sum(one(spark, S.weights_to_bytes([F.lit(0.1), F.lit(0.7), F.lit(0.31)]))) == 255


@pytest.mark.parametrize(("tag", "want"), [("30'6\"", 9.2964), ("30 ft", 9.144), ("12 m", 12.0), ("12,5", 12.5), ("0", None), ("tall", None)])
def test_heights(spark, tag, want):
    got = one(spark, S.parse_height(F.lit(tag)))
    assert got == want or abs(got - want) < 1e-9


@pytest.mark.parametrize(("clock", "want"), [("07:30", 27000), ("24:00", None), ("7h", None)])
def test_clock(spark, clock, want):
    assert one(spark, S.clock_to_s(F.lit(clock))) == want


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 0, 1.0), (2, 3, 1, 1.0), (3, 1, 2, 1.0), (3, 4, 3, 1.0), (1, 3, 4, 5.0)], "u long, v long, edge_idx long, c double")
    got = {r.node_id: r.component for r in N.strong_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    anchor = spark.createDataFrame([(4,)], "node_id long")
    tree = N.distances(edges, anchor, "c")
    assert {r.node_id: r.dist for r in tree.collect()} == {4: 0.0, 3: 1.0, 2: 2.0, 1: 3.0}
    path = N.paths(tree, edges, spark.createDataFrame([(4, 1)], "anchor long, node_id long")).first()
    assert path.path == [0, 1, 3]


def test_bootstraps_draw_from_every_school(spark):
    """Draws worked out one by one over all schools of sf0.01."""
    from gridmill.plans.choice_queries import approval_bootstrap, bootstrap_indices
    from gridmill.plans.views import table

    sf = "/root/testdata/sf0.01"
    value = {r.school_id: r.curb_spots for r in table(spark, sf, "schools").collect()}
    n = len(value)
    drawn = spark.sql(f"select rep, pmod(xxhash64(9, rep, i), {n}) as k from (select id as rep, explode(sequence(0, {n - 1})) as i from range(400))").collect()
    want = {}
    for r in drawn:
        want.setdefault(r.rep, []).append(value[r.k])
    got = {r.rep: r["mean"] for r in bootstrap_indices(spark, sf).collect()}
    assert n > 10 and got == pytest.approx({rep: sum(v) / n for rep, v in want.items()})
    assert approval_bootstrap(spark, sf).first().approval == pytest.approx(100 * sum(v > 5 for v in value.values()) / n)
