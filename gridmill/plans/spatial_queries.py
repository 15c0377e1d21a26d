"""Queries over spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import spatial as S
from gridmill.plans.views import table
from gridmill.registry import query


def _polygons(spark, sf_dir):
    return table(spark, sf_dir, "boxes").select("box_id", "class", S.box_ring(F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1")).alias("ring"))


def _targets(spark, sf_dir, name="nodes", key="node_id"):
    return table(spark, sf_dir, name).select(key, F.col("x").alias("x2"), F.col("z").alias("z2"))


# off the grid of the boxes' edges, so that no point lies on a border
_HOMES = "SELECT household_id, x + 3.7e-1 AS x, z + 2.3e-1 AS z, income_band, vehicles FROM {homes}"


def _homes(spark, sf_dir):
    return spark.sql(_HOMES, homes=table(spark, sf_dir, "homes"))


_IN = "h.x > b.x0 AND h.x < b.x1 AND h.z > b.z0 AND h.z < b.z1"


@query(f"WITH h AS ({_HOMES}) SELECT h.household_id, ARG_MIN(b.class, ROW(ROUND((b.x1 - b.x0) * (b.z1 - b.z0), 3), b.box_id)) AS class FROM h LEFT JOIN {{boxes}} b ON {_IN} GROUP BY h.household_id")
def point_in_polygon_smallest(spark, sf_dir):
    return S.smallest_polygon(_homes(spark, sf_dir), _polygons(spark, sf_dir), "household_id", "class", "box_id", 500)


@query(f"WITH h AS ({_HOMES}) SELECT h.household_id, MIN(b.box_id) AS box_id FROM h LEFT JOIN {{boxes}} b ON {_IN} GROUP BY h.household_id")
def point_in_polygon_first(spark, sf_dir):
    return S.first_polygon(_homes(spark, sf_dir), _polygons(spark, sf_dir), "household_id", "box_id", 500)


@query(f"WITH h AS ({_HOMES}) SELECT b.box_id, COUNT(*) AS homes, SUM(h.vehicles) AS vehicles, MEDIAN(h.vehicles) AS median_vehicles FROM h JOIN {{boxes}} b ON {_IN} GROUP BY b.box_id")
def zonal_join(spark, sf_dir):
    met = S.points_in_polygons(_homes(spark, sf_dir), _polygons(spark, sf_dir), 500)
    return met.groupBy("box_id").agg(F.count("*").alias("homes"), F.sum("vehicles").alias("vehicles"), F.percentile("vehicles", F.lit(0.5)).alias("median_vehicles"))


_D = "SQRT(POW(h.x - n.x, 2) + POW(h.z - n.z, 2))"


@query(f"WITH h AS ({_HOMES}) SELECT h.household_id, ARG_MIN(n.node_id, ROW({_D}, n.node_id)) AS node_id, ROUND(MIN({_D}), 6) AS d FROM h CROSS JOIN {{nodes}} n GROUP BY h.household_id")
def nearest_point(spark, sf_dir):
    return S.nearest(_homes(spark, sf_dir), _targets(spark, sf_dir), "household_id", "node_id", 200).withColumn("d", F.round("d", 6))


@query(f"WITH h AS ({_HOMES}) SELECT h.household_id, ARG_MIN(n.node_id, ROW({_D}, n.node_id)) AS node_id FROM h CROSS JOIN {{nodes}} n WHERE n.signalized GROUP BY h.household_id")
def nearest_of_class(spark, sf_dir):
    signals = table(spark, sf_dir, "nodes").where("signalized").select("node_id", F.col("x").alias("x2"), F.col("z").alias("z2"))
    return S.nearest(_homes(spark, sf_dir), signals, "household_id", "node_id", 200).drop("d")


_SEGMENTS = "SELECT e.edge_idx, a.x AS x0, a.z AS z0, b.x AS x1, b.z AS z1 FROM {edges} e JOIN {nodes} a ON a.node_id = e.u JOIN {nodes} b ON b.node_id = e.v WHERE e.highway <> 'motorway'"
_T = "GREATEST(0e0, LEAST(1e0, ((h.x - s.x0) * (s.x1 - s.x0) + (h.z - s.z0) * (s.z1 - s.z0)) / (POW(s.x1 - s.x0, 2) + POW(s.z1 - s.z0, 2))))"
_E = f"SQRT(POW(h.x - s.x0 - {_T} * (s.x1 - s.x0), 2) + POW(h.z - s.z0 - {_T} * (s.z1 - s.z0), 2))"


@query(f"""
WITH h AS ({_HOMES}), s AS ({_SEGMENTS}),
m AS (SELECT h.household_id, s.edge_idx, {_E} AS d, SQRT(POW(h.x - s.x1, 2) + POW(h.z - s.z1, 2)) AS e FROM h JOIN s ON ABS(h.x - s.x0) < 500 AND ABS(h.z - s.z0) < 500),
b AS (SELECT household_id, edge_idx, d, e, MIN(d) OVER (PARTITION BY household_id) AS least FROM m WHERE d <= 120)
SELECT h.household_id, b.edge_idx, ROUND(b.least, 6) AS d FROM h LEFT JOIN (SELECT household_id, ARG_MIN(edge_idx, ROW(ROUND(e, 6), edge_idx)) AS edge_idx, MIN(least) AS least FROM b WHERE d <= least + 5e-1 GROUP BY household_id) b ON b.household_id = h.household_id""")
def nearest_segment(spark, sf_dir):
    segments = spark.sql(_SEGMENTS, edges=table(spark, sf_dir, "edges"), nodes=table(spark, sf_dir, "nodes"))
    return S.nearest_segment(_homes(spark, sf_dir), segments, "household_id", 120).withColumn("d", F.round("d", 6))


@query(f"""
WITH h AS ({_HOMES}), p AS (SELECT a.household_id, COUNT(b.household_id) AS neighbours, COUNT(*) FILTER (WHERE b.vehicles >= 2) AS n_marked FROM h a LEFT JOIN h b ON a.household_id <> b.household_id AND SQRT(POW(a.x - b.x, 2) + POW(a.z - b.z, 2)) <= 300 GROUP BY a.household_id)
SELECT household_id, neighbours, n_marked, n_marked >= 2 AND n_marked >= 5e-1 * neighbours AS flag FROM p""")
def neighbourhood_share_self_join(spark, sf_dir):
    return S.neighbour_share(_homes(spark, sf_dir), "household_id", 300, F.col("vehicles") >= 2, 2, 0.5)


_SEG = "SQRT(POW({0}.x - (b.x0 + {1} * (b.x1 - b.x0)), 2) + POW({0}.z - (b.z0 + {1} * (b.z1 - b.z0)), 2))"
_ALONG = "LEAST(GREATEST((({0}.x - b.x0) * (b.x1 - b.x0) + ({0}.z - b.z0) * (b.z1 - b.z0)) / (POW(b.x1 - b.x0, 2) + POW(b.z1 - b.z0, 2)), 0), 1)"


def _off(point):
    return _SEG.format(point, _ALONG.format(point))


@query(f"WITH h AS ({_HOMES}), e AS (SELECT p.person_id, p.household_id, n.x, n.z FROM {{persons}} p JOIN {{schools}} s ON s.school_id = p.person_id % 10 JOIN {{nodes}} n ON n.node_id = s.node_id), b AS (SELECT * FROM {{boxes}} WHERE box_id % 9 = 0) SELECT person_id FROM e WHERE EXISTS (SELECT 1 FROM b WHERE {_off('e')} <= 403.7) OR household_id IN (SELECT household_id FROM h WHERE EXISTS (SELECT 1 FROM b WHERE {_off('h')} <= 403.7))")
def catchment_join(spark, sf_dir):
    """Persons whose home or school lies near a line."""
    lines = table(spark, sf_dir, "boxes").where("box_id % 9 = 0").select("x0", "z0", "x1", "z1", F.lit(403.7).alias("reach"))
    sites = table(spark, sf_dir, "schools").join(table(spark, sf_dir, "nodes"), "node_id").select("school_id", "x", "z")
    persons = table(spark, sf_dir, "persons").withColumn("school_id", F.col("person_id") % 10)
    homes = persons.join(_homes(spark, sf_dir).select("household_id", "x", "z"), "household_id").select("person_id", "x", "z")
    return S.within_segments(homes.union(persons.join(sites, "school_id").select("person_id", "x", "z")), lines, 403.7).select("person_id").distinct()


@query(f"""
WITH h AS ({_HOMES}), r AS (SELECT a.x AS x0, a.z AS z0, c.x AS x1, c.z AS z1, e.lanes * 3.5 AS half_m FROM {{edges}} e JOIN {{nodes}} a ON a.node_id = e.u JOIN {{nodes}} c ON c.node_id = e.v WHERE e.u < e.v AND e.highway = 'primary')
SELECT household_id FROM h WHERE NOT EXISTS (SELECT 1 FROM {{boxes}} o WHERE o.box_id % 2 = 0 AND SQRT(POW(GREATEST(o.x0 - h.x, h.x - o.x1, 0), 2) + POW(GREATEST(o.z0 - h.z, h.z - o.z1, 0), 2)) <= 20.3) AND NOT EXISTS (SELECT 1 FROM r b WHERE {_off('h')} <= half_m + 20.3)""")
def clearance_anti_join(spark, sf_dir):
    n = table(spark, sf_dir, "nodes")
    at = lambda s, i: n.select(F.col("node_id").alias(s), F.col("x").alias(f"x{i}"), F.col("z").alias(f"z{i}"))
    roads = table(spark, sf_dir, "edges").where("u < v and highway = 'primary'").join(at("u", 0), "u").join(at("v", 1), "v").withColumn("half_m", F.col("lanes") * 3.5)
    return S.clear_of(_homes(spark, sf_dir), table(spark, sf_dir, "boxes").where("box_id % 2 = 0"), roads, 20.3, 40.0, "household_id").select("household_id")


@query(f"WITH h AS ({_HOMES}), c AS (SELECT CAST(FLOOR(x / 500) AS BIGINT) AS cx, CAST(FLOOR(z / 500) AS BIGINT) AS cz, COUNT(*) AS n FROM h GROUP BY 1, 2) SELECT cx, cz, n FROM c WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM {{nodes}} t WHERE t.signalized AND FLOOR(t.x / 500) = cx AND FLOOR(t.z / 500) = cz)")
def gap_cells_anti_join(spark, sf_dir):
    at = lambda df: df.select(S.cell(F.col("x"), 500).alias("cx"), S.cell(F.col("z"), 500).alias("cz"))
    full = at(_homes(spark, sf_dir)).groupBy("cx", "cz").agg(F.count("*").alias("n")).where("n >= 2")
    return full.join(at(table(spark, sf_dir, "nodes").where("signalized")), ["cx", "cz"], "left_anti")


_PUPILS = "SELECT p.person_id, p.grade, h.x, h.z FROM {persons} p JOIN {homes} h ON h.household_id = p.household_id WHERE p.grade >= 0"
_SITES = "SELECT s.school_id, s.g0, s.g1, n.x AS x2, n.z AS z2 FROM {schools} s JOIN {nodes} n ON n.node_id = s.node_id"


@query(f"WITH p AS ({_PUPILS}), s AS ({_SITES}) SELECT p.person_id, ARG_MIN(s.school_id, ROW(ROUND(SQRT(POW(p.x - s.x2, 2) + POW(p.z - s.z2, 2)), 6), s.school_id)) AS school_id FROM p LEFT JOIN s ON p.grade BETWEEN s.g0 AND s.g1 GROUP BY p.person_id")
def banded_nearest_join(spark, sf_dir):
    pupils = spark.sql(_PUPILS, persons=table(spark, sf_dir, "persons"), homes=table(spark, sf_dir, "homes"))
    return S.banded_nearest(pupils, spark.sql(_SITES, schools=table(spark, sf_dir, "schools"), nodes=table(spark, sf_dir, "nodes")))


@query("SELECT node_id, ROUND((DEGREES(ATAN2(x - 4.9e3, 1.1e3 - z)) + 360) % 360, 4) AS bearing FROM {nodes} WHERE x <> 4.9e3")
def bearings(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes").where("x <> 4.9e3")
    return nodes.select("node_id", F.round(S.bearing(F.lit(4.9e3), F.lit(1.1e3), F.col("x"), F.col("z")), 4).alias("bearing"))


_GAP = "LEAST(ROUND((DEGREES(ATAN2(x - 4.9e3, 1.1e3 - z)) + 720 - e.deg) % 360, 6), 360 - ROUND((DEGREES(ATAN2(x - 4.9e3, 1.1e3 - z)) + 720 - e.deg) % 360, 6))"


@query(f"SELECT node_id, ARG_MIN(e.exit_id, ROW(ROUND({_GAP}, 4), e.exit_id)) AS exit_id FROM {{nodes}} CROSS JOIN (VALUES (1, 1e1), (2, 8.5e1), (3, 1.7e2), (4, 2.95e2)) AS e(exit_id, deg) WHERE x <> 4.9e3 GROUP BY node_id")
def bearing_argmin_join(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes").where("x <> 4.9e3").withColumn("b", S.bearing(F.lit(4.9e3), F.lit(1.1e3), F.col("x"), F.col("z")))
    gaps = [F.struct(F.round(S.circular_gap(F.round("b", 6), F.lit(d)), 4).alias("gap"), F.lit(i).alias("exit_id")) for i, d in ((1, 10.0), (2, 85.0), (3, 170.0), (4, 295.0))]
    return nodes.select("node_id", F.array_min(F.array(*gaps))["exit_id"].alias("exit_id"))


@query(f"""
WITH h AS ({_HOMES}), b AS (SELECT h.household_id AS id, MIN(ROW(ROUND({_D}, 6), n.node_id)) AS m FROM h JOIN {{nodes}} n ON {_D} <= 90 GROUP BY 1),
r AS (SELECT id, m[2] AS id2, m[1] AS d, ROW_NUMBER() OVER (PARTITION BY m[2] ORDER BY m[1], id) AS k FROM b) SELECT id, id2, d FROM r WHERE k = 1""")
def tolerance_match_one_to_one(spark, sf_dir):
    homes = _homes(spark, sf_dir).select(F.col("household_id").alias("id"), "x", "z")
    return S.match_one_to_one(homes, _targets(spark, sf_dir).withColumnRenamed("node_id", "id2"), 90)


_PATH = "SELECT j.trip, j.step, n.x, n.z FROM {trajectory} j JOIN {nodes} n ON n.node_id = j.edge_idx"


@query(f"SELECT trip, step, ROUND(SUM(s) OVER (PARTITION BY trip ORDER BY step ROWS UNBOUNDED PRECEDING), 3) AS along_m FROM (SELECT trip, step, COALESCE(SQRT(POW(x - LAG(x) OVER w, 2) + POW(z - LAG(z) OVER w, 2)), 0) AS s FROM ({_PATH}) p WINDOW w AS (PARTITION BY trip ORDER BY step)) t")
def arc_length(spark, sf_dir):
    rows = spark.sql(_PATH, trajectory=table(spark, sf_dir, "trajectory"), nodes=table(spark, sf_dir, "nodes"))
    return S.arc_length(rows, "trip", "step").select("trip", "step", F.round("along_m", 3).alias("along_m"))


@query("SELECT node_id FROM {nodes} WHERE x BETWEEN 1e3 AND 5e3 AND z BETWEEN 2.5e2 AND 2e3")
def extent_filter(spark, sf_dir):
    return table(spark, sf_dir, "nodes").where(F.col("x").between(1e3, 5e3) & F.col("z").between(250.0, 2e3)).select("node_id")


@query("SELECT school_id, ROUND(SUM((g1 - g0 + 1) * n.x) / SUM(g1 - g0 + 1), 6) AS cx, ROUND(SUM((g1 - g0 + 1) * n.z) / SUM(g1 - g0 + 1), 6) AS cz FROM (SELECT school_id % 5 AS school_id, node_id, g0, g1 FROM {schools}) s JOIN {nodes} n USING (node_id) GROUP BY school_id")
def area_weighted_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "schools").withColumn("school_id", F.col("school_id") % 5).withColumn("a", F.col("g1") - F.col("g0") + 1).join(table(spark, sf_dir, "nodes"), "node_id")
    at = lambda c: F.round(F.sum(F.col("a") * F.col(c)) / F.sum("a"), 6)
    return rows.groupBy("school_id").agg(at("x").alias("cx"), at("z").alias("cz"))


@query("""
WITH d AS (SELECT n_nationkey AS k, n_nationkey * 47 % 360 * 1e0 AS bearing, (n_nationkey % 5 + 1) / 75e0 AS share FROM {nation}), e AS (SELECT s_suppkey AS exit_id, s_suppkey * 5 % 90 + 2e1 AS exit_bearing FROM {supplier}),
m AS (SELECT k, share, exit_id, LEAST((bearing - exit_bearing + 720) % 360, 360 - (bearing - exit_bearing + 720) % 360) AS gap FROM d CROSS JOIN e),
w AS (SELECT *, EXP(-0.5 * POW(gap / 12, 2)) AS g, SUM(EXP(-0.5 * POW(gap / 12, 2))) OVER (PARTITION BY k) AS total, MIN(gap) OVER (PARTITION BY k) AS least FROM m),
v AS (SELECT *, CASE WHEN total >= 1e-6 THEN g WHEN gap = least THEN 1e0 ELSE 0 END AS u FROM w)
SELECT exit_id, ROUND(SUM(s), 8) AS share FROM (SELECT exit_id, share * u / SUM(u) OVER (PARTITION BY k) AS s FROM v) t GROUP BY exit_id""")
def direction_shares(spark, sf_dir):
    """Exits lie in one quarter of the circle, so that some directions are far from all of them."""
    k = F.col("n_nationkey")
    directions = table(spark, sf_dir, "nation").select((k * 47 % 360 * 1.0).alias("bearing"), ((k % 5 + 1) / 75.0).alias("share"))
    exits = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("exit_id"), (F.col("s_suppkey") * 5 % 90 + 20.0).alias("exit_bearing"))
    return S.direction_shares(directions, exits, 12.0).withColumn("share", F.round("share", 8))


_ZONES = "SELECT box_id, CASE WHEN box_id % 4 = 0 THEN (x0 + x1) / 2 - 5 ELSE x0 END AS x0, CASE WHEN box_id % 4 = 0 THEN (x0 + x1) / 2 + 5 ELSE x1 END AS x1, CASE WHEN box_id % 4 = 0 THEN (z0 + z1) / 2 - 5 ELSE z0 END AS z0, CASE WHEN box_id % 4 = 0 THEN (z0 + z1) / 2 + 5 ELSE z1 END AS z1 FROM {boxes}"
_RASTER = "SELECT CAST(FLOOR((6.003e3 - (y * 50 + 1.7e-1)) / 4e1) AS BIGINT) AS r, CAST(FLOOR((x * 50 + 1.3e-1 - 7) / 4e1) AS BIGINT) AS c, AVG(z) AS v, COUNT(*) AS n FROM {points} GROUP BY 1, 2"


@query(f"""
WITH b AS ({_ZONES}), f AS ({_RASTER}),
i AS (SELECT box_id, UNNEST(RANGE(CAST(FLOOR((6.003e3 - z1) / 40) - 1 AS BIGINT), CAST(FLOOR((6.003e3 - z0) / 40) + 2 AS BIGINT))) AS r, x0, x1, z0, z1 FROM b),
k AS (SELECT *, UNNEST(RANGE(CAST(FLOOR((x0 - 7) / 40) - 1 AS BIGINT), CAST(FLOOR((x1 - 7) / 40) + 2 AS BIGINT))) AS c FROM i),
h AS (SELECT k.box_id, f.v, f.n FROM k LEFT JOIN f ON f.r = k.r AND f.c = k.c WHERE 7 + (k.c + 0.5) * 40 BETWEEN x0 AND x1 AND 6.003e3 - (k.r + 0.5) * 40 BETWEEN z0 AND z1),
s AS (SELECT box_id, COUNT(*) AS covered, ROUND(COUNT(v) * 1e0 / COUNT(*), 6) AS cover, COALESCE(SUM(n), 0) AS points, ROUND(COALESCE(SUM(n), 0) / (COUNT(*) * 16e2), 8) AS density,
 ROUND(QUANTILE_CONT(v, 0.5), 6) AS median, ROUND(QUANTILE_CONT(v, 0.9), 6) AS p90, ROUND(QUANTILE_CONT(v, 0.05), 6) AS eave, ROUND(QUANTILE_CONT(v, 0.99), 6) AS ridge FROM h GROUP BY box_id)
SELECT * FROM s UNION ALL SELECT b.box_id, 0, NULL, 0, NULL, ROUND(f.v, 6), ROUND(f.v, 6), ROUND(f.v, 6), ROUND(f.v, 6) FROM b LEFT JOIN f ON f.r = CAST(FLOOR((6.003e3 - (b.z0 + b.z1) / 2) / 40) AS BIGINT) AND f.c = CAST(FLOOR(((b.x0 + b.x1) / 2 - 7) / 40) AS BIGINT) WHERE b.box_id NOT IN (SELECT box_id FROM s)""")
def zonal_raster_stats(spark, sf_dir):
    """Heights of 40 m cells inside boxes, a quarter of them so small that some cover no cell's centre."""
    zones = spark.sql(_ZONES, boxes=table(spark, sf_dir, "boxes")).select("box_id", S.box_ring(F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1")).alias("ring"))
    cells = spark.sql(_RASTER, points=table(spark, sf_dir, "points")).select(F.col("r").alias("row"), F.col("c").alias("col"), "v", "n")
    out = S.zonal_cells(zones, cells, "box_id", 7.0, 6003.0, 40.0)
    six = [F.round(c, 6).alias(c) for c in ("median", "p90", "eave", "ridge")]
    return out.select("box_id", F.col("covered").cast("long"), F.round("cover", 6).alias("cover"), F.col("points").cast("long"), F.round("density", 8).alias("density"), *six)
