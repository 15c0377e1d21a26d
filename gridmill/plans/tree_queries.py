"""Queries over canopy heights."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridmill.operators import grid as G
from gridmill.operators import trees as T
from gridmill.plans.views import table
from gridmill.registry import query

_SIZE, _SIGMA, _LEAST = 2.0, 0.3, 5.0
_G = [math.exp(-0.5 * (k / _SIGMA) ** 2) for k in (-1, 0, 1)]
_W = [g / sum(_G) for g in _G]


def _weight(c: str) -> str:
    return f"(CASE {c} WHEN 0 THEN {_W[1]!r} ELSE {_W[0]!r} END)"


def _canopy(spark, sf_dir):
    cells = G.cell_stats(table(spark, sf_dir, "points"), 0, 200, _SIZE, "z").select("row", "col", F.col("max_v").cast("double").alias("v"))
    return T.smoothed(cells, "v", _SIGMA)


@query(f"""
WITH RECURSIVE raw AS (SELECT CAST(FLOOR((200 - y) / 2e0) AS BIGINT) AS "row", CAST(FLOOR(x / 2e0) AS BIGINT) AS col, MAX(z) * 1e0 AS v FROM {{points}} GROUP BY 1, 2),
c AS (SELECT a."row", a.col, ROUND(SUM(b.v * {_weight('b."row" - a."row"')} * {_weight('b.col - a.col')}), 6) AS v FROM raw a JOIN raw b ON ABS(a."row" - b."row") <= 1 AND ABS(a.col - b.col) <= 1 GROUP BY 1, 2),
p AS (SELECT a."row", a.col, a.v, a."row" * 1000000 + a.col AS id FROM c a JOIN c b ON ABS(a."row" - b."row") <= 1 AND ABS(a.col - b.col) <= 1 WHERE a.v >= {_LEAST} GROUP BY 1, 2, 3 HAVING a.v >= MAX(b.v) - 1e-4),
same(id, other) AS (SELECT id, id FROM p UNION SELECT s.id, b.id FROM same s JOIN p a ON a.id = s.other JOIN p b ON ABS(a."row" - b."row") <= 1 AND ABS(a.col - b.col) <= 1),
clump AS (SELECT id, MIN(other) AS first FROM same GROUP BY id),
t AS (SELECT first, CAST(ROUND_EVEN(AVG("row"), 0) AS BIGINT) AS "row", CAST(ROUND_EVEN(AVG(col), 0) AS BIGINT) AS col, MAX(v) AS v FROM p JOIN clump USING (id) GROUP BY first)
SELECT "row", col, v FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE SQRT(POW(a."row" - b."row", 2) + POW(a.col - b.col, 2)) * {_SIZE} <= LEAST(GREATEST((3.09632e0 + 0.00895e0 * a.v * a.v) / 2, 1), 5) + 1e-9
 AND (b.v > a.v OR b.v = a.v AND b.first < a.first))""")
def tree_tops(spark, sf_dir):
    return T.tree_tops(_canopy(spark, sf_dir), _SIZE, _LEAST)


@query()
def crown_assignment(spark, sf_dir):
    """Crowns of the tops by flooding: SQL has no queue, tests hold it against a flood on one machine."""
    cells = _canopy(spark, sf_dir)
    return T.crowns(cells, T.tree_tops(cells, _SIZE, _LEAST), _SIZE)
