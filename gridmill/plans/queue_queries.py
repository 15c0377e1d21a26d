"""Queries over queues, chains and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import queues as Q
from gridmill.plans.views import table
from gridmill.registry import query

_SERVICE = 40 / 6
_QUEUE = """
WITH RECURSIVE o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entrance, day ORDER BY arr_s, event_id) AS r FROM {curb_arrivals}),
q AS (SELECT entrance, day, event_id, r, arr_s, w, 4e1 / 6 * w AS service, CAST(arr_s AS DOUBLE) AS begin FROM o WHERE r = 1
 UNION ALL SELECT o.entrance, o.day, o.event_id, o.r, o.arr_s, o.w, 4e1 / 6 * o.w, GREATEST(CAST(o.arr_s AS DOUBLE), q.begin + q.service) FROM q JOIN o ON o.entrance = q.entrance AND o.day = q.day AND o.r = q.r + 1)"""


def _queue(spark, sf_dir):
    rows = table(spark, sf_dir, "curb_arrivals")
    return Q.fluid_queue(rows, ["entrance", "day"], ["arr_s", "event_id"], "arr_s", F.col("w") * F.lit(_SERVICE))


def _recursive(select: str) -> str:
    from gridmill.plans.views import VIEWS

    return _QUEUE.replace("{curb_arrivals}", f"({VIEWS['curb_arrivals']}) c").replace("{events}", "events") + select


@query(_recursive(" SELECT entrance, event_id, ROUND(begin - arr_s, 4) AS wait FROM q"))
def fluid_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("entrance", "event_id", F.round("wait", 4).alias("wait"))


@query(_recursive(" SELECT a.event_id, ROUND(SUM(CASE WHEN b.r <= a.r THEN b.w ELSE 0 END) - SUM(CASE WHEN b.r <= a.r AND ROUND(b.begin, 6) <= a.arr_s THEN b.w ELSE 0 END), 4) AS queue FROM q a JOIN q b ON a.entrance = b.entrance AND a.day = b.day GROUP BY a.event_id"))
def queue_length_at_arrival(spark, sf_dir):
    queued = _queue(spark, sf_dir).withColumn("begin", F.round("begin", 6))
    return Q.queue_at_arrival(queued, ["entrance", "day"], "event_id", "arr_s", "w").select("event_id", F.round("queue", 4).alias("queue"))


@query(_recursive("""
, m AS (SELECT entrance, day, CAST(FLOOR(arr_s / 3600.0) AS BIGINT) AS bin, w AS d FROM q UNION ALL SELECT entrance, day, CAST(FLOOR(ROUND(begin, 6) / 3600.0) AS BIGINT), -w FROM q),
g AS (SELECT k.entrance, k.day, b.bin FROM (SELECT DISTINCT entrance, day FROM q) k CROSS JOIN (SELECT UNNEST(RANGE(30)) AS bin) b), n AS (SELECT entrance, day, CAST(FLOOR(arr_s / 3600.0) AS BIGINT) AS bin, COUNT(*) AS arrivals, ROUND(AVG(begin - arr_s), 4) AS mean_wait, ROUND(MAX(begin - arr_s), 4) AS max_wait FROM q GROUP BY 1, 2, 3),
s AS (SELECT g.entrance, g.day, g.bin, ROUND(COALESCE((SELECT SUM(d) FROM m WHERE m.entrance = g.entrance AND m.day = g.day AND m.bin <= g.bin), 0), 4) + 0 AS waiting FROM g)
SELECT s.entrance, s.day, s.bin, waiting, ROUND(GREATEST(waiting - 2, 0) * 7.5, 3) AS spill_m, COALESCE(arrivals, 0) AS arrivals, mean_wait, max_wait FROM s LEFT JOIN n ON n.entrance = s.entrance AND n.day = s.day AND n.bin = s.bin"""))
def queue_bin_stats(spark, sf_dir):
    queued = _queue(spark, sf_dir).withColumn("begin", F.round("begin", 6))
    out = Q.queue_bins(queued, ["entrance", "day"], "arr_s", 3600, 30, "w", 2, 7.5)
    return out.withColumns({"waiting": F.round("waiting", 4) + 0, "spill_m": F.round("spill_m", 3), "mean_wait": F.round("mean_wait", 4), "max_wait": F.round("max_wait", 4)})


@query("""
WITH RECURSIVE a AS (SELECT event_id, entrance, day, CAST(arr_s AS DOUBLE) AS arr, 3e2 * w AS s, 6e1 + event_id % 5 * 240 AS p, ROW_NUMBER() OVER (PARTITION BY entrance, day ORDER BY arr_s, event_id) AS r FROM {curb_arrivals}),
q(entrance, day, r, event_id, wait, free) AS (SELECT entrance, day, r, event_id, 0e0, arr + s FROM a WHERE r = 1
 UNION ALL SELECT a.entrance, a.day, a.r, a.event_id, GREATEST(q.free - a.arr, 0), CASE WHEN GREATEST(q.free - a.arr, 0) <= a.p THEN GREATEST(q.free, a.arr) + a.s ELSE q.free END FROM q JOIN a ON a.entrance = q.entrance AND a.day = q.day AND a.r = q.r + 1)
SELECT q.event_id, CASE WHEN q.wait <= a.p THEN ROUND(q.wait, 4) END AS wait, q.wait > a.p AS balked FROM q JOIN a ON a.event_id = q.event_id""")
def queue_with_balking(spark, sf_dir):
    """Five minutes for a whole car, and patience from one minute to seventeen."""
    rows = table(spark, sf_dir, "curb_arrivals").withColumn("service", 300.0 * F.col("w")).withColumn("patience", 60.0 + F.col("event_id") % 5 * 240)
    return Q.queue_with_balking(rows, ["entrance", "day"], "arr_s", "service", "patience", ["arr_s", "event_id"]).select("event_id", F.round("wait", 4).alias("wait"), "balked")


_KIDS = "SELECT p.household_id, p.person_id, s.school_id, s.bell_s, 120 + s.school_id % 5 * 60 AS leg_s FROM {persons} p JOIN {schools} s ON s.school_id = p.person_id % 10 WHERE p.grade >= 0"


def _kids(spark, sf_dir):
    return spark.sql(_KIDS, persons=table(spark, sf_dir, "persons"), schools=table(spark, sf_dir, "schools"))


@query(f"""
WITH k AS ({_KIDS}), s AS (SELECT household_id, school_id, MIN(bell_s) AS target_s, COUNT(*) AS kids, MAX(leg_s) AS leg_s FROM k GROUP BY 1, 2)
SELECT household_id, school_id, target_s, kids, (r - 1) // 3 AS chain, (r - 1) % 3 AS stop, SUM(leg_s) OVER (PARTITION BY household_id, (r - 1) // 3 ORDER BY r) AS expected_s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY household_id ORDER BY target_s, school_id) AS r FROM s) t""")
def chain_stops(spark, sf_dir):
    return Q.chain_stops(_kids(spark, sf_dir))


@query(f"WITH k AS ({_KIDS}) SELECT person_id, school_id, CAST(FLOOR((ROW_NUMBER() OVER w - 1) * CEIL(COUNT(*) OVER g / 4e0) / COUNT(*) OVER g) AS BIGINT) AS run FROM k WINDOW w AS (PARTITION BY school_id ORDER BY bell_s, person_id), g AS (PARTITION BY school_id)")
def even_run_assignment(spark, sf_dir):
    return Q.even_runs(_kids(spark, sf_dir), ["school_id"], ["bell_s", "person_id"], 4).select("person_id", "school_id", "run")


_LEGS = "SELECT *, 1e2 AS free_s FROM {trajectory}"


@query("SELECT trip, step, GREATEST(enter_s + dwell_s - COALESCE(LAG(enter_s + dwell_s) OVER (PARTITION BY trip ORDER BY step), enter_s) - 1e2, 0) AS delay_s FROM {trajectory}")
def chain_experience(spark, sf_dir):
    rows = table(spark, sf_dir, "trajectory").withColumn("free_s", F.lit(100.0))
    return Q.chain_experience(rows).select("trip", "step", "delay_s")


@query("SELECT trip, n, SUM(n) OVER (ORDER BY trip) - n AS \"offset\", edges FROM (SELECT trip, COUNT(*) AS n, ARRAY_TO_STRING(LIST(edge_idx ORDER BY step), ',') AS edges FROM {trajectory} GROUP BY trip) t")
def trajectory_assembly(spark, sf_dir):
    return Q.assemble(table(spark, sf_dir, "trajectory")).withColumn("edges", F.array_join(F.col("edges").cast("array<string>"), ","))


@query("SELECT t.t, j.trip, j.edge_idx, ROUND((t.t - j.enter_s) / (j.dwell_s * 1e0), 6) AS fraction FROM {trajectory} j JOIN (VALUES (0), (300), (777), (1500)) AS t(t) ON j.enter_s <= t.t AND t.t < j.enter_s + j.dwell_s")
def interval_join_position_at_time(spark, sf_dir):
    times = spark.createDataFrame([(0,), (300,), (777,), (1500,)], "t long")
    return Q.position_at(table(spark, sf_dir, "trajectory"), times).withColumn("fraction", F.round("fraction", 6))


_VALUES = "SELECT bin, edge_idx, MAX(vc) AS vc FROM {seed_edge_bin} GROUP BY bin, edge_idx"


@query(f"SELECT trip, step, j.edge_idx, vc FROM {{trajectory}} j JOIN ({_VALUES}) v ON v.edge_idx = j.edge_idx AND v.bin = LEAST(GREATEST(CAST(FLOOR(j.enter_s / 60.0) AS BIGINT), 0), 47)")
def time_bin_lookup_join(spark, sf_dir):
    values = spark.sql(_VALUES, seed_edge_bin=table(spark, sf_dir, "seed_edge_bin"))
    return Q.bin_lookup(table(spark, sf_dir, "trajectory"), values, 60, 48).select("trip", "step", "edge_idx", "vc")


@query("SELECT a.edge_idx AS approach, b.edge_idx AS upstream FROM {edges} a JOIN {edges} b ON a.u = b.v AND a.v <> b.u")
def upstream_edge_self_join(spark, sf_dir):
    return Q.upstream_edges(table(spark, sf_dir, "edges"))


@query("""
WITH c AS (SELECT s_suppkey % 200 AS edge_idx, s_suppkey % 40 AS b0, s_suppkey % 40 + 1 + s_suppkey % 5 AS b1, 5e-1 AS factor, 60 AS delay_s FROM {supplier}),
l AS (SELECT DISTINCT bin, edge_idx FROM {seed_edge_bin})
SELECT l.bin, l.edge_idx, COALESCE(PRODUCT(factor), 1) AS factor, COALESCE(SUM(delay_s), 0) AS delay_s FROM l LEFT JOIN c ON c.edge_idx = l.edge_idx AND l.bin >= b0 AND l.bin < b1 GROUP BY l.bin, l.edge_idx""")
def closure_range_join(spark, sf_dir):
    closures = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 200 AS edge_idx", "s_suppkey % 40 AS start_bin", "s_suppkey % 40 + 1 + s_suppkey % 5 AS end_bin", "5e-1 AS factor", "60 AS delay_s")
    return Q.with_closures(table(spark, sf_dir, "seed_edge_bin").select("bin", "edge_idx").distinct(), closures)


@query("SELECT school_id, run, bell_s - 300 - run * headway_s AS arrive_s FROM (SELECT school_id, bell_s, 300 + school_id % 3 * 300 AS headway_s FROM {schools}) s JOIN RANGE(6) AS r(run) ON run < GREATEST(FLOOR(1800 / headway_s), 1)")
def arrival_schedule(spark, sf_dir):
    routes = table(spark, sf_dir, "schools").selectExpr("school_id", "bell_s", "300 + school_id % 3 * 300 AS headway_s")
    return Q.arrival_schedule(routes, 300, 1800).select("school_id", "run", "arrive_s")
