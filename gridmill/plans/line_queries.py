"""Queries over lines, tours, plans' tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import lines as L
from gridmill.plans.views import table
from gridmill.registry import query

_PATH = "SELECT j.trip, j.step, n.x, n.z FROM {trajectory} j JOIN {nodes} n ON n.node_id = j.edge_idx"


def _path(spark, sf_dir):
    return spark.sql(_PATH, trajectory=table(spark, sf_dir, "trajectory"), nodes=table(spark, sf_dir, "nodes"))


def _segments(spark, sf_dir):
    rows = table(spark, sf_dir, "trajectory").groupBy(F.col("trip").alias("segment_id")).agg(F.collect_list(F.struct((F.col("step") / 8).alias("at"), F.col("edge_idx").alias("id"))).alias("connectors"))
    return rows.withColumn("length_m", F.lit(400.0))


_PIECES = "SELECT trip AS segment_id, edge_idx AS from_id, LEAD(edge_idx) OVER (PARTITION BY trip ORDER BY step) AS to_id, 5e1 AS piece_m FROM {trajectory}"


@query(f"SELECT * FROM ({_PIECES}) t WHERE to_id IS NOT NULL AND to_id <> from_id")
def connector_split(spark, sf_dir):
    return L.split_at_connectors(_segments(spark, sf_dir))


@query(f"""
WITH p AS (SELECT * FROM ({_PIECES}) t WHERE to_id IS NOT NULL AND to_id <> from_id), c AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS n FROM (SELECT from_id AS id FROM p UNION SELECT to_id FROM p) u),
f AS (SELECT segment_id, a.n AS u, b.n AS v, piece_m FROM p JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id)
SELECT * FROM f UNION ALL SELECT segment_id, v, u, piece_m FROM f WHERE segment_id % 3 > 0""")
def graph_from_connectors(spark, sf_dir):
    return L.graph_from_connectors(L.split_at_connectors(_segments(spark, sf_dir)), F.col("segment_id") % 3 > 0)[1]


@query(f"""
WITH p AS ({_PATH}), s AS (SELECT trip, step, x AS x0, z AS z0, LEAD(x) OVER w AS x1, LEAD(z) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY trip ORDER BY step)),
d AS (SELECT *, SQRT(POW(x1 - x0, 2) + POW(z1 - z0, 2)) AS d FROM s WHERE x1 IS NOT NULL), e AS (SELECT *, SUM(d) OVER (PARTITION BY trip ORDER BY step ROWS UNBOUNDED PRECEDING) AS e, SUM(d) OVER (PARTITION BY trip) AS total FROM d),
h AS (SELECT *, f.f * total AS g FROM e CROSS JOIN (VALUES (2.5e-1), (6e-1)) AS f(f) WHERE d > 0)
SELECT trip, f, ROUND(x0 + (g - e + d) / d * (x1 - x0), 3) AS x, ROUND(z0 + (g - e + d) / d * (z1 - z0), 3) AS z FROM h WHERE g > e - d AND g <= e""")
def linear_reference(spark, sf_dir):
    rows = L.along(_path(spark, sf_dir), "trip", [0.25, 0.6])
    return rows.select("trip", "f", F.round("x", 3).alias("x"), F.round("z", 3).alias("z"))


@query(f"""
WITH p AS ({_PATH}), s AS (SELECT trip, step, x AS x0, z AS z0, LEAD(x) OVER w AS x1, LEAD(z) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY trip ORDER BY step)),
n AS (SELECT *, GREATEST(CAST(CEIL(COALESCE(SQRT(POW(x1 - x0, 2) + POW(z1 - z0, 2)), 0) / 900) AS INTEGER), 1) AS n FROM s)
SELECT trip, step, k.k AS part, ROUND(x0 + COALESCE(k.k * 1e0 / n * (x1 - x0), 0), 3) AS x, ROUND(z0 + COALESCE(k.k * 1e0 / n * (z1 - z0), 0), 3) AS z FROM n JOIN (SELECT CAST(UNNEST(RANGE(40)) AS INTEGER) AS k) k ON k.k < n""")
def densified_lines(spark, sf_dir):
    out = L.densified(_path(spark, sf_dir), "trip", 900.0)
    return out.select("trip", "step", "part", F.round("x", 3).alias("x"), F.round("z", 3).alias("z"))


@query(f"""
WITH p AS ({_PATH}), s AS (SELECT trip, step, x AS x0, z AS z0, LEAD(x) OVER w AS x1, LEAD(z) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY trip ORDER BY step)),
d AS (SELECT *, SQRT(POW(x1 - x0, 2) + POW(z1 - z0, 2)) AS d FROM s WHERE x1 IS NOT NULL), e AS (SELECT *, SUM(d) OVER (PARTITION BY trip ORDER BY step ROWS UNBOUNDED PRECEDING) AS e FROM d),
h AS (SELECT *, (k.n + 0.5) * 777 AS g FROM e JOIN (SELECT UNNEST(RANGE(120)) AS n) k ON ROUND((e - d) / 777 - 0.5, 9) <= k.n AND k.n < ROUND(e / 777 - 0.5, 9) WHERE d > 0)
SELECT trip, CAST(n AS INTEGER) AS n, ROUND(x0 + (g - e + d) / d * (x1 - x0) - (z1 - z0) / d * 6, 2) + 0 AS x, ROUND(z0 + (g - e + d) / d * (z1 - z0) + (x1 - x0) / d * 6, 2) + 0 AS z FROM h""")
def offset_points(spark, sf_dir):
    out = L.every(_path(spark, sf_dir), "trip", 777.0, 6.0)
    return out.select("trip", "n", (F.round("x", 2) + 0).alias("x"), (F.round("z", 2) + 0).alias("z"))


_ENDS = "SELECT e.edge_idx, a.x AS x0, a.z AS z0, b.x AS x1, b.z AS z1 FROM {edges} e JOIN {nodes} a ON a.node_id = e.u JOIN {nodes} b ON b.node_id = e.v"


@query(f"""
SELECT edge_idx, ROUND(CASE WHEN z0 = z1 THEN CASE WHEN z0 BETWEEN 3e2 AND 1.1e3 THEN GREATEST(LEAST(GREATEST(x0, x1), 4.1e3) - GREATEST(LEAST(x0, x1), 1.1e3), 0) / ABS(x1 - x0) ELSE 0 END
 ELSE CASE WHEN x0 BETWEEN 1.1e3 AND 4.1e3 THEN GREATEST(LEAST(GREATEST(z0, z1), 1.1e3) - GREATEST(LEAST(z0, z1), 3e2), 0) / ABS(z1 - z0) ELSE 0 END END, 6) AS inside FROM ({_ENDS}) s""")
def rect_clip_length(spark, sf_dir):
    rows = spark.sql(_ENDS, edges=table(spark, sf_dir, "edges"), nodes=table(spark, sf_dir, "nodes"))
    share = L.clip_share(*(F.col(c) for c in ("x0", "z0", "x1", "z1")), (1.1e3, 3e2, 4.1e3, 1.1e3))
    return rows.select("edge_idx", F.round(share, 6).alias("inside"))


@query("""
WITH RECURSIVE p AS (SELECT trip, step, edge_idx FROM {trajectory}), w AS (SELECT trip, step, edge_idx, 0e0 AS enter_s, 2e1 + edge_idx % 7 AS exit_s FROM p WHERE step = 1
 UNION ALL SELECT p.trip, p.step, p.edge_idx, w.exit_s, w.exit_s + 20 + p.edge_idx % 7 + 10 * LEAST(FLOOR(w.exit_s / 60), 3) FROM w JOIN p ON p.trip = w.trip AND p.step = w.step + 1)
SELECT trip, edge_idx, enter_s, exit_s FROM w""".replace("{trajectory}", "(SELECT l_orderkey AS trip, l_partkey AS edge_idx, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step FROM lineitem) j"))
def time_dependent_traversal(spark, sf_dir):
    times = F.transform(F.array(*[F.lit(b) for b in range(4)]), lambda b: (20.0 + F.col("edge_idx") % 7 + 10 * b).cast("double"))
    rows = table(spark, sf_dir, "trajectory").withColumn("times", times).groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("step", "edge_idx", "times"))).alias("p"))
    trips = rows.select("trip", F.lit(0.0).alias("depart_s"), F.transform("p", lambda e: F.struct(e["edge_idx"].alias("edge_idx"), e["times"].alias("times"))).alias("path"))
    return L.traverse(trips, 60, 4)


@query("""
WITH RECURSIVE s AS (SELECT s.school_id % 8 AS route, s.school_id AS id, n.x, n.z FROM {schools} s JOIN {nodes} n ON n.node_id = s.node_id),
f AS (SELECT route, ARG_MAX(id, ROW(ROUND(SQRT(x * x + z * z), 6), -id)) AS id, COUNT(*) AS n FROM s GROUP BY route),
w(route, k, tour, x, z, km) AS (SELECT s.route, CAST(1 AS BIGINT), [s.id], s.x, s.z, CAST([SQRT(s.x * s.x + s.z * s.z)] AS DOUBLE[]) FROM s JOIN f ON f.route = s.route AND f.id = s.id
 UNION ALL SELECT w.route, w.k + 1, list_append(w.tour, c.m[2]), s.x, s.z, list_append(w.km, SQRT(POW(s.x - w.x, 2) + POW(s.z - w.z, 2))) FROM w, LATERAL (SELECT MIN(ROW(ROUND(SQRT(POW(s.x - w.x, 2) + POW(s.z - w.z, 2)), 6), s.id)) AS m FROM s WHERE s.route = w.route AND NOT list_contains(w.tour, s.id)) c JOIN s ON s.id = c.m[2])
SELECT w.route, array_to_string(w.tour, ',') AS tour, ROUND((COALESCE(list_sum(w.km[2:]), 0) + SQRT(w.x * w.x + w.z * w.z)) * 1.3 / 1000, 4) AS ride_km FROM w JOIN f ON f.route = w.route AND f.n = w.k""")
def nearest_neighbour_tour(spark, sf_dir):
    """The order of the stops, and the way from the first to the school along it."""
    stops = table(spark, sf_dir, "schools").join(table(spark, sf_dir, "nodes"), "node_id")
    routes = stops.groupBy((F.col("school_id") % 8).alias("route")).agg(F.collect_list(F.struct(F.col("school_id").alias("id"), "x", "z")).alias("stops"))
    tours = L.greedy_tour(routes.withColumn("x", F.lit(0.0)).withColumn("z", F.lit(0.0)), 1.3)
    return tours.select("route", F.array_join(F.col("tour").cast("array<string>"), ",").alias("tour"), F.round(F.get("ride_km", 0), 4).alias("ride_km"))


@query("""
SELECT h.household_id, ROUND(MIN(SQRT(POW(h.x - b.x0, 2) + POW(h.z - b.z0, 2))) FILTER (WHERE SQRT(POW(h.x - b.x0, 2) + POW(h.z - b.z0, 2)) <= 250), 4) AS building_m,
 (SELECT ROUND(MIN(SQRT(POW(h.x - n.x, 2) + POW(h.z - n.z, 2))), 4) FROM {nodes} n WHERE SQRT(POW(h.x - n.x, 2) + POW(h.z - n.z, 2)) <= 60) AS road_m FROM {homes} h CROSS JOIN {boxes} b GROUP BY h.household_id, h.x, h.z""")
def nearest_two_layers(spark, sf_dir):
    at = lambda df, x, z: df.select(F.col(x).alias("x2"), F.col(z).alias("z2"))
    out = L.nearest_two(table(spark, sf_dir, "homes"), at(table(spark, sf_dir, "boxes"), "x0", "z0"), at(table(spark, sf_dir, "nodes"), "x", "z"), "household_id")
    null = lambda c: F.when(F.col(c) < float("inf"), F.round(c, 4)).alias(c)
    return out.select("household_id", null("building_m"), null("road_m"))


@query(f"""
WITH p AS ({_PATH}), c AS (SELECT p.trip, p.step, MAX(CASE WHEN SQRT(POW(p.x - n.x, 2) + POW(p.z - n.z, 2)) <= 260 THEN 1 ELSE 0 END) AS near FROM p CROSS JOIN (SELECT * FROM {{nodes}} WHERE node_id % 9 = 0) n GROUP BY p.trip, p.step)
SELECT trip, ROUND(AVG(near), 6) AS covered, AVG(near) <= 5e-1 AS missing FROM c GROUP BY trip""")
def coverage_share_join(spark, sf_dir):
    roads = table(spark, sf_dir, "nodes").where("node_id % 9 = 0").select(F.col("x").alias("x2"), F.col("z").alias("z2"))
    return L.covered_share(_path(spark, sf_dir), roads, "trip", 260).withColumn("covered", F.round("covered", 6))


@query("(SELECT c_custkey, 'low' AS side FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 4) UNION ALL (SELECT c_custkey, 'high' FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 4)")
def polar_topk(spark, sf_dir):
    return L.polar(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 4).select("c_custkey", "side")


@query("""
WITH t AS (SELECT trip AS plan_id, step - 1 AS pos, 'tool' || CAST(edge_idx % 4 AS VARCHAR) AS tool, dwell_s AS amount, ROW_NUMBER() OVER (PARTITION BY trip, edge_idx % 4 ORDER BY step) AS nth FROM {trajectory})
SELECT plan_id, pos, tool || CASE WHEN nth > 1 THEN ' ' || CAST(nth AS VARCHAR) ELSE '' END AS label, CASE WHEN tool = 'tool3' THEN 'unknown tool' WHEN tool = 'tool0' AND nth > 1 THEN 'repeated' WHEN amount NOT BETWEEN 50 AND 400 THEN 'out of range' END AS error FROM t""")
def plan_check(spark, sf_dir):
    plans = table(spark, sf_dir, "trajectory").groupBy(F.col("trip").alias("plan_id")).agg(F.array_sort(F.collect_list(F.struct("step", F.concat(F.lit("tool"), (F.col("edge_idx") % 4).cast("string")).alias("tool"), F.col("dwell_s").alias("amount")))).alias("tools"))
    known = spark.createDataFrame([("tool0", 50, 400, True), ("tool1", 50, 400, False), ("tool2", 50, 400, False)], "tool string, lo long, hi long, once boolean")
    return L.checked_tools(plans, known)


@query("SELECT p_partkey AS id, CONCAT('s', CAST(p_size % 6 AS VARCHAR), '.', p_brand) AS path FROM {part} WHERE p_size % 6 IN (1, 2) AND p_partkey % 3 > 0")
def assumption_leaves(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("s"), (F.col("p_size") % 6).cast("string"), F.lit("."), "p_brand").alias("path"), (F.col("p_partkey") % 3 == 0).alias("verified"))
    return L.flat_leaves(rows, spark.createDataFrame([("s1",), ("s2",)], "section string")).select("id", "path")
