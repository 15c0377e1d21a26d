"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import grid as G
from gridmill.operators.ground import triangulated
from gridmill.plans.views import table
from gridmill.registry import query

_AT = "CAST(FLOOR((200 - y) / {s}) AS BIGINT) AS \"row\", CAST(FLOOR(x / {s}) AS BIGINT) AS col"


def _at(size):
    return _AT.format(s=f"{size:g}")


@query(f"SELECT {_at(5.0)}, MAX(z) AS max_v, MIN(z) AS min_v, ROUND(AVG(z), 6) AS mean_v, SUM(z) AS sum_v, COUNT(*) AS n FROM {{points}} GROUP BY 1, 2")
def grid_cell_stat(spark, sf_dir):
    return G.cell_stats(table(spark, sf_dir, "points"), 0, 200, 5, "z").withColumn("mean_v", F.round("mean_v", 6))


@query("SELECT CONCAT('r', CAST(FLOOR(y / 50) AS BIGINT), '_c', CAST(FLOOR(x / 50) AS BIGINT)) AS tile, COUNT(*) AS n, ROUND(SUM(z), 3) AS z FROM {points} GROUP BY 1")
def tile_partitioned_points(spark, sf_dir):
    return G.tiles(table(spark, sf_dir, "points"), 50).groupBy("tile").agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("z"))


def _filled(passes):
    """CTEs f1.. to `filled` that fill null v of f0 from around, pass after pass, then from the nearest."""
    step = """f{1} AS (SELECT a."row", a.col, COALESCE(a.v, AVG(b.v)) AS v FROM f{0} a LEFT JOIN f{0} b ON ABS(a."row" - b."row") <= 1 AND ABS(a.col - b.col) <= 1 GROUP BY a."row", a.col, a.v)"""
    last = f"""filled AS (SELECT a."row", a.col, COALESCE(a.v, (SELECT ARG_MIN(b.v, ROW(ROUND(SQRT(POW(a."row" - b."row", 2) + POW(a.col - b.col, 2)), 9), b."row", b.col)) FROM f{passes} b WHERE b.v IS NOT NULL)) AS v FROM f{passes} a)"""
    return ", ".join([*(step.format(i, i + 1) for i in range(passes)), last])


@query(f"""
WITH c AS (SELECT {_at(10.0)}, AVG(z) FILTER (WHERE cls = 2) AS dtm, MAX(z) AS top FROM {{points}} GROUP BY 1, 2), l AS (SELECT MIN("row") AS r0, MAX("row") AS r1, MIN(col) AS c0, MAX(col) AS c1 FROM c),
g AS (SELECT r."row", k.col FROM (SELECT UNNEST(RANGE(r0, r1 + 1)) AS "row" FROM l) r CROSS JOIN (SELECT UNNEST(RANGE(c0, c1 + 1)) AS col FROM l) k), f0 AS (SELECT g."row", g.col, c.dtm AS v FROM g LEFT JOIN c ON c."row" = g."row" AND c.col = g.col), {_filled(3)},
s AS (SELECT c."row", c.col, f.v AS dtm, c.top FROM c JOIN filled f ON f."row" = c."row" AND f.col = c.col)
SELECT "row", col, ROUND(dtm, 5) AS dtm, ROUND(GREATEST(top, dtm), 5) AS dsm, ROUND(GREATEST(GREATEST(top, dtm) - dtm, 0), 5) AS height FROM s""")
def surface_model(spark, sf_dir):
    out = G.surface_model(table(spark, sf_dir, "points"), 0, 200, 10, 2)
    return out.select("row", "col", *[F.round(c, 5).alias(c) for c in ("dtm", "dsm", "height")])


@query()
def ground_by_triangles(spark, sf_dir):
    """Bare ground where nothing but other returns are: tests hold it against triangles found one by one."""
    ground = table(spark, sf_dir, "points").where("cls = 7")
    cells = G.cell_stats(ground, 0, 200, 2, "z").select("row", "col", F.col("mean_v").alias("z"))
    return triangulated(cells, "z")


_CELLS = f"SELECT {_at(5.0)}, MAX(z) AS v FROM {{points}} GROUP BY 1, 2"


def _cells(spark, sf_dir):
    return G.cell_stats(table(spark, sf_dir, "points"), 0, 200, 5, "z").select("row", "col", F.col("max_v").alias("v"))


@query(f"""
WITH c AS ({_CELLS}), l AS (SELECT MIN("row") AS r0, MAX("row") AS r1, MIN(col) AS c0, MAX(col) AS c1 FROM c),
f0 AS (SELECT r."row", k.col, c.v FROM (SELECT UNNEST(RANGE(r0, r1 + 1)) AS "row" FROM l) r CROSS JOIN (SELECT UNNEST(RANGE(c0, c1 + 1)) AS col FROM l) k LEFT JOIN c ON c."row" = r."row" AND c.col = k.col), {_filled(2)}
SELECT "row", col, ROUND(v, 5) AS v FROM filled""")
def gap_fill(spark, sf_dir):
    return G.filled_frame(_cells(spark, sf_dir), "v", 2).withColumn("v", F.round("v", 5))


_COUNTS = f"SELECT {_at(5.0)}, COUNT(*) FILTER (WHERE z > 2e1) AS elevated, COUNT(*) FILTER (WHERE z > 2e1 AND cls % 2 = 0) AS many FROM {{points}} GROUP BY 1, 2"


@query(f"WITH c AS ({_COUNTS}) SELECT a.\"row\", a.col, ROUND(SUM(b.many) / NULLIF(SUM(b.elevated), 0), 6) AS ratio FROM c a JOIN c b ON ABS(a.\"row\" - b.\"row\") <= 2 AND ABS(a.col - b.col) <= 2 GROUP BY 1, 2")
def moving_window_ratio(spark, sf_dir):
    """Returns above 20 m that are multiple, over all above it, in windows of five cells; cells that lack points on the way of a pass count as empty."""
    points = G.grid_cells(table(spark, sf_dir, "points"), 0, 200, 5)
    cells = points.groupBy("row", "col").agg(F.count_if(F.col("z") > 20).alias("elevated"), F.count_if((F.col("z") > 20) & (F.col("cls") % 2 == 0)).alias("many"))
    return G.window_ratio(G.dense(cells, ["elevated", "many"]), 2, "many", "elevated").join(cells.select("row", "col"), ["row", "col"], "left_semi").withColumn("ratio", F.round("ratio", 6))


@query(f"WITH c AS ({_CELLS}) SELECT a.\"row\", a.col, ROUND(SQRT(GREATEST(SUM(b.v * b.v) - SUM(b.v) * SUM(b.v) / 9 - (POW(SUM(b.v * (b.\"row\" - a.\"row\")), 2) + POW(SUM(b.v * (b.col - a.col)), 2)) / 6, 0) / 9), 5) AS residual FROM c a JOIN c b ON ABS(a.\"row\" - b.\"row\") <= 1 AND ABS(a.col - b.col) <= 1 GROUP BY 1, 2 HAVING COUNT(*) = 9")
def plane_residual(spark, sf_dir):
    return G.plane_residual(_cells(spark, sf_dir), "v").withColumn("residual", F.round("residual", 5))


@query(f"WITH c AS ({_CELLS}) SELECT \"row\", col, v FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE (a.\"row\" <> b.\"row\" OR a.col <> b.col) AND ABS(a.\"row\" - b.\"row\") <= 2 AND ABS(a.col - b.col) <= 2 AND (b.v > a.v OR b.v = a.v AND (b.\"row\" < a.\"row\" OR b.\"row\" = a.\"row\" AND b.col < a.col)))")
def local_maxima(spark, sf_dir):
    return G.local_maxima(_cells(spark, sf_dir), "v", 2)


@query(f"""
WITH f AS (SELECT r.r AS "row", k.k AS col, r.r * 3 + k.k * k.k * 1e0 AS v FROM RANGE(40) AS r(r) CROSS JOIN RANGE(40) AS k(k)),
p AS (SELECT node_id, LEAST(GREATEST(FLOOR(z / 130), 0), 38) AS r, LEAST(GREATEST(FLOOR(x / 260), 0), 38) AS c, z / 130 AS fr, x / 260 AS fc FROM {{nodes}}),
w AS (SELECT node_id, r, c, LEAST(GREATEST(fr - r, 0), 1) AS a, LEAST(GREATEST(fc - c, 0), 1) AS b FROM p)
SELECT w.node_id, ROUND(SUM((CASE WHEN f."row" = w.r THEN 1 - a ELSE a END) * (CASE WHEN f.col = w.c THEN 1 - b ELSE b END) * f.v), 5) AS v FROM w JOIN f ON f."row" IN (w.r, w.r + 1) AND f.col IN (w.c, w.c + 1) GROUP BY w.node_id""")
def bilinear_sample_join(spark, sf_dir):
    field = spark.range(1600).selectExpr("id div 40 AS row", "id % 40 AS col").withColumn("v", F.col("row") * 3 + F.col("col") * F.col("col") * 1.0)
    points = table(spark, sf_dir, "nodes").select("node_id", (F.col("z") / 130).alias("fr"), (F.col("x") / 260).alias("fc"))
    return G.bilinear(points, field, "node_id", 40, 40, "v").withColumn("v", F.round("v", 5))


_MASKS = f"c AS ({_CELLS}), a AS (SELECT \"row\", col FROM c WHERE v >= 48), b AS (SELECT \"row\" + 1 AS \"row\", col - 2 AS col FROM a WHERE (\"row\" + col) % 5 > 0)"


@query(f"""
WITH {_MASKS}, s AS (SELECT d.i AS dr, e.i AS dc, COUNT(*) AS n FROM a CROSS JOIN (SELECT UNNEST(RANGE(-3, 4)) AS i) d CROSS JOIN (SELECT UNNEST(RANGE(-3, 4)) AS i) e JOIN b ON b."row" = a."row" + d.i AND b.col = a.col + e.i GROUP BY 1, 2),
r AS (SELECT dr, dc, ROUND(n / ((SELECT COUNT(*) FROM a) + (SELECT COUNT(*) FROM b) - n * 1e0), 6) AS iou FROM s)
SELECT dr, dc, iou, COALESCE((SELECT iou FROM r WHERE dr = 0 AND dc = 0), 0) AS iou_unshifted FROM r ORDER BY iou DESC, dr, dc LIMIT 1""")
def shift_iou(spark, sf_dir):
    a = _cells(spark, sf_dir).where("v >= 48").select("row", "col")
    return G.best_shift(a, a.where("(row + col) % 5 > 0").selectExpr("row + 1 AS row", "col - 2 AS col"), 3)


def _errors(part, group=""):
    q = ", ".join(f"ROUND(QUANTILE_CONT(e, {p}), 6) AS {n}" for p, n in ((0.5, "median"), (0.05, "p5"), (0.95, "p95")))
    return f"SELECT {part} AS part, COUNT(*) AS n, {q}, ROUND(AVG(e), 6) AS mean, ROUND(AVG(ABS(e)), 6) AS mae, ROUND(SQRT(AVG(e * e)), 6) AS rmse, ROUND(AVG(CASE WHEN ABS(e) <= 1 THEN 1e0 ELSE 0 END), 6) AS within_1, ROUND(AVG(CASE WHEN ABS(e) <= 2 THEN 1e0 ELSE 0 END), 6) AS within_2, ROUND(CORR(z, x), 6) AS corr FROM t {group}"


@query(f"WITH t AS (SELECT cls, (z - 25) / 10 AS e, z, x FROM {{points}}) {_errors(chr(39) + 'all' + chr(39))} UNION ALL {_errors('CONCAT(' + chr(39) + 'cls=' + chr(39) + ', cls)', 'GROUP BY cls')}")
def error_summary(spark, sf_dir):
    out = G.error_summary(table(spark, sf_dir, "points").select("cls", ((F.col("z") - 25) / 10).alias("e"), "z", "x"), "e", ["cls"], ("z", "x"))
    return out.select("part", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])
