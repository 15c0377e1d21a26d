"""Queries over campus entrances, exits, workers outside and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import entrances as E
from gridmill.operators import population as P
from gridmill.operators.spatial import box_ring
from gridmill.plans.views import table
from gridmill.registry import query

RANKS = {"primary": 4, "secondary": 3, "tertiary": 2, "residential": 1}

# distance of the box (x0, z0, x1, z1) to the box (u0, w0, u1, w1); edges of the grid and points are boxes too
_GAP = "SQRT(POW(GREATEST(x0 - u1, u0 - x1, 0), 2) + POW(GREATEST(z0 - w1, w0 - z1, 0), 2))"


@query(f"""
WITH c AS (SELECT box_id AS campus, x0, z0, x1, z1, (x0 + x1) / 2 + box_id % 3 * 40 AS cx, (z0 + z1) / 2 - box_id % 4 * 30 AS cz FROM {{boxes}}),
l AS (SELECT e.*, CASE highway WHEN 'primary' THEN 4 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 2 ELSE 1 END AS rank, LEAST(a.x, b.x) AS u0, GREATEST(a.x, b.x) AS u1, LEAST(a.z, b.z) AS w0, GREATEST(a.z, b.z) AS w1
 FROM {{edges}} e JOIN {{nodes}} a ON a.node_id = e.u JOIN {{nodes}} b ON b.node_id = e.v WHERE highway <> 'motorway'),
m AS (SELECT c.campus, l.name, l.rank, l.edge_idx, l.u, l.v, GREATEST(LEAST(cx, u1), u0) AS px, GREATEST(LEAST(cz, w1), w0) AS pz, ROUND(SQRT(POW(GREATEST(cx - u1, u0 - cx, 0), 2) + POW(GREATEST(cz - w1, w0 - cz, 0), 2)), 6) AS d FROM c JOIN l ON {_GAP} <= 150),
r AS (SELECT campus, ARG_MIN(name, ROW(-rank, d, name)) AS name FROM (SELECT campus, name, MAX(rank) AS rank, MIN(d) AS d FROM m GROUP BY 1, 2) t GROUP BY 1),
o AS (SELECT m.* FROM m JOIN r ON r.campus = m.campus AND r.name = m.name),
p AS (SELECT campus, ANY_VALUE(name) AS name, ARG_MIN(ROW(px, pz), ROW(d, edge_idx)) AS p FROM o GROUP BY 1),
f AS (SELECT c.*, p.name, COALESCE(p.p[1], cx) AS px, COALESCE(p.p[2], cz) AS pz FROM c LEFT JOIN p ON p.campus = c.campus),
s AS (SELECT campus, ARG_MIN(ROW(bx, bz), ROW(ROUND(SQRT(POW(bx - px, 2) + POW(bz - pz, 2)), 6), i)) AS b FROM (
 SELECT campus, px, pz, 1 AS i, GREATEST(LEAST(px, x1), x0) AS bx, z0 AS bz FROM f UNION ALL SELECT campus, px, pz, 2, x1, GREATEST(LEAST(pz, z1), z0) FROM f
 UNION ALL SELECT campus, px, pz, 3, GREATEST(LEAST(px, x1), x0), z1 FROM f UNION ALL SELECT campus, px, pz, 4, x0, GREATEST(LEAST(pz, z1), z0) FROM f) t GROUP BY 1),
a AS (SELECT v AS node_id, ARG_MAX(edge_idx, ROW(length_m, -edge_idx)) AS approach_edge FROM {{edges}} WHERE highway <> 'motorway' GROUP BY 1),
n AS (SELECT n.node_id, a.approach_edge, n.x AS u0, n.x AS u1, n.z AS w0, n.z AS w1 FROM {{nodes}} n JOIN a ON a.node_id = n.node_id),
k AS (SELECT f.campus, f.name, n.node_id, n.approach_edge, s.b[1] AS x, s.b[2] AS z, SQRT(POW(n.u0 - s.b[1], 2) + POW(n.w0 - s.b[2], 2)) AS snap_m FROM f JOIN s ON s.campus = f.campus JOIN n ON {_GAP} <= 150
 WHERE {_GAP} <= 60 OR EXISTS (SELECT 1 FROM o WHERE o.campus = f.campus AND n.node_id IN (o.u, o.v)))
SELECT campus, e.node_id AS node_id, e.approach_edge AS approach_edge, ROUND(e.x, 4) AS x, ROUND(e.z, 4) AS z, ROUND(e.snap_m, 4) AS snap_m, e.name AS main_road FROM (SELECT campus, ARG_MIN(k, ROW(ROUND(snap_m, 6), node_id)) AS e FROM k GROUP BY campus) t""")
def campus_entrance(spark, sf_dir):
    """The node on the side of a campus that faces its main road, and the edge by which it is reached."""
    k = F.col("box_id")
    core = [((F.col("x0") + F.col("x1")) / 2 + k % 3 * 40).alias("core_x"), ((F.col("z0") + F.col("z1")) / 2 - k % 4 * 30).alias("core_z")]
    campuses = table(spark, sf_dir, "boxes").select(k.alias("campus"), box_ring(F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1")).alias("ring"), *core)
    edges = table(spark, sf_dir, "edges").withColumnRenamed("name", "road")
    out = E.campus_entrances(campuses, table(spark, sf_dir, "nodes").select("node_id", "x", "z"), edges, RANKS, ["motorway"])
    return out.select("campus", "node_id", "approach_edge", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"), F.round("snap_m", 4).alias("snap_m"), "main_road")


@query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS exit_id, (s_suppkey * 7 + k * 3) % 40 AS node_id, s_acctbal % 97 + k * 11 % 7 AS d FROM {supplier} CROSS JOIN (SELECT UNNEST(RANGE(6)) AS k) t),
w(exit_id, used, node_id) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
 UNION ALL SELECT w.exit_id + 1, CASE WHEN x.n IS NULL THEN used ELSE list_append(used, x.n) END, x.n FROM w, LATERAL (SELECT ARG_MIN(c.node_id, ROW(c.d, c.node_id)) AS n FROM c WHERE c.exit_id = w.exit_id + 1 AND NOT list_contains(w.used, c.node_id)) x WHERE w.exit_id < (SELECT MAX(s_suppkey) FROM {supplier})),
a AS (SELECT s_suppkey AS exit_id, s_acctbal * 1e0 AS x, s_suppkey * 37 % 1000 * 1e0 AS z FROM {supplier}),
s AS (SELECT w.exit_id, w.node_id, a.x, a.z FROM w JOIN a ON a.exit_id = w.exit_id WHERE w.node_id IS NOT NULL)
SELECT exit_id, node_id, NULL AS via FROM s UNION ALL
SELECT l.exit_id, ARG_MIN(s.node_id, ROW(ROUND(SQRT(POW(s.x - l.x, 2) + POW(s.z - l.z, 2)), 6), s.exit_id)), ARG_MIN(s.exit_id, ROW(ROUND(SQRT(POW(s.x - l.x, 2) + POW(s.z - l.z, 2)), 6), s.exit_id)) FROM a l CROSS JOIN s WHERE l.exit_id NOT IN (SELECT exit_id FROM s) GROUP BY l.exit_id""")
def exit_via(spark, sf_dir):
    """Exits whose nodes are all taken leave by the snapped exit nearest to their place."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("exit_id"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") * 37 % 1000).cast("double").alias("z"), "s_acctbal")
    k = F.explode(F.sequence(F.lit(0), F.lit(5)))
    near = rows.select("exit_id", "s_acctbal", k.alias("k")).select("exit_id", ((F.col("exit_id") * 7 + F.col("k") * 3) % 40).alias("node_id"), (F.col("s_acctbal") % 97 + F.col("k") * 11 % 7).alias("d"))
    return E.via_exits(P.snap_unique(near), rows.select("exit_id", "x", "z"))


@query("""
WITH p AS (SELECT person_id, is_worker, CASE WHEN person_id % 3 = 0 THEN person_id % 20 END AS work_exit, person_id * 17 % (SELECT COUNT(*) * 2 FROM {part}) AS work_node, CASE WHEN person_id % 11 > 0 THEN person_id * 131 % 10000 * 1e0 END AS x, person_id * 53 % 12500 * 1e0 AS z FROM {persons}),
x AS (SELECT school_id, MIN(node_id) AS node_id FROM {schools} WHERE school_id % 2 = 0 GROUP BY 1), n AS (SELECT * FROM {nodes} WHERE node_id % 5 > 0)
SELECT p.person_id, x.school_id AS work_exit, COALESCE(x.node_id, (SELECT node_id FROM n WHERE n.node_id = p.work_node), CASE WHEN p.is_worker AND p.x IS NOT NULL THEN (SELECT ARG_MIN(n.node_id, ROW(ROUND(SQRT(POW(n.x - p.x, 2) + POW(n.z - p.z, 2)), 6), n.node_id)) FROM n) END) AS work_node
FROM p LEFT JOIN x ON x.school_id = p.work_exit""")
def work_repair(spark, sf_dir):
    """Workers outside work at their exit; those whose node is gone, at the nearest to their place."""
    n, k = table(spark, sf_dir, "part").count() * 2, F.col("person_id")
    place = [F.when(k % 11 > 0, (k * 131 % 10000).cast("double")).alias("work_x"), (k * 53 % 12500).cast("double").alias("work_z")]
    persons = table(spark, sf_dir, "persons").select("person_id", "is_worker", F.when(k % 3 == 0, k % 20).alias("work_exit"), (k * 17 % n).alias("work_node"), *place)
    exits = table(spark, sf_dir, "schools").where("school_id % 2 = 0").select(F.col("school_id").alias("exit_id"), "node_id")
    nodes = table(spark, sf_dir, "nodes").where("node_id % 5 > 0").select("node_id", F.col("x").alias("x2"), F.col("z").alias("z2"))
    return E.repaired_work(persons, exits, nodes)


@query("""
WITH s AS (SELECT s_suppkey AS scene, s_suppkey * 37 % 101 * 1e0 AS cloud, s_nationkey AS date, s_suppkey % 3 AS version FROM {supplier} WHERE s_suppkey * 37 % 101 <= 40 ORDER BY 2, 1 LIMIT 8),
b AS (SELECT l_suppkey AS scene, AVG(CASE WHEN l_linenumber IN (3, 6) THEN 1e0 ELSE 0 END) AS bad FROM {lineitem} GROUP BY 1),
t AS (SELECT LIST({'scene': s.scene, 'bad': COALESCE(b.bad, 1), 'date': s.date, 'version': s.version} ORDER BY s.cloud, s.scene) AS l FROM s LEFT JOIN b ON b.scene = s.scene),
f AS (SELECT list_reduce(l, lambda a, x: CASE WHEN x.bad < a.bad - 2e-2 OR ABS(x.bad - a.bad) <= 2e-2 AND ROW(x.date, x.version) > ROW(a.date, a.version) THEN x ELSE a END) AS r FROM t)
SELECT r.scene AS scene, ROUND(r.bad, 6) AS bad_share FROM f""")
def clearest_scene(spark, sf_dir):
    """Suppliers as scenes, their line items as classified pixels; shares within 0.02 count as ties, which the later date wins."""
    k = F.col("s_suppkey")
    scenes = table(spark, sf_dir, "supplier").select(k.alias("scene"), (k * 37 % 101).cast("double").alias("cloud"), F.col("s_nationkey").alias("date"), (k % 3).alias("version"))
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scene"), F.col("l_linenumber").alias("cls"))
    return E.best_scene(scenes, pixels, 40.0, [3, 6], tie=0.02).select("scene", F.round("bad_share", 6).alias("bad_share"))
