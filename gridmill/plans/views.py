"""Views that give the driver's tables the shape of the operators' inputs.

The SQL is plain enough for Spark and for DuckDB; {name} stands for a table or
another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"}

VIEWS = {
    "nodes": """
SELECT p_partkey AS node_id, CAST(p_partkey % 40 AS DOUBLE) * 2.5e2 AS x,
 FLOOR(p_partkey / 40.0) * 2.5e2 AS z, p_retailprice AS y, p_size % 5 = 0 AS signalized
FROM {part}""",
    "edges": """
SELECT a.p_partkey * 4 + d.k AS edge_idx, a.p_partkey AS u, b.p_partkey AS v,
 CASE a.p_type WHEN 'LARGE' THEN 'motorway' WHEN 'STANDARD' THEN 'primary' WHEN 'MEDIUM' THEN 'secondary'
  WHEN 'PROMO' THEN 'tertiary' ELSE 'residential' END AS highway,
 1 + a.p_size % 4 AS lanes, 2.5e2 + a.p_size AS length_m, CONCAT('Road ', a.p_brand) AS name
FROM {part} a JOIN (VALUES (0, 1), (1, -1), (2, 40), (3, -40)) AS d(k, step) ON TRUE
JOIN {part} b ON b.p_partkey = a.p_partkey + d.step
WHERE d.k >= 2 OR FLOOR(a.p_partkey / 40.0) = FLOOR(b.p_partkey / 40.0)""",
    "households": """
SELECT CAST(FLOOR(c_custkey / 3.0) AS BIGINT) AS household_id, c_custkey * 7919 % (SELECT COUNT(*) FROM {part}) AS home_node,
 c_custkey % 4 AS vehicles, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'lt50k' WHEN 'BUILDING' THEN '50_100k'
  WHEN 'FURNITURE' THEN '100_150k' WHEN 'HOUSEHOLD' THEN '150_200k' ELSE 'gt200k' END AS income_band
FROM {customer} WHERE c_custkey % 3 = 0""",
    "persons": """
SELECT c_custkey AS person_id, CAST(FLOOR(c_custkey / 3.0) AS BIGINT) AS household_id, c_custkey * 37 % 90 AS age,
 c_custkey * 37 % 90 BETWEEN 19 AND 64 AND c_custkey % 5 <> 0 AS is_worker,
 CASE WHEN c_custkey * 37 % 90 BETWEEN 5 AND 17 THEN c_custkey * 37 % 90 - 5 ELSE -1 END AS grade
FROM {customer}""",
    "schools": """
SELECT s_suppkey AS school_id, s_suppkey * 13 % (SELECT COUNT(*) FROM {part}) AS node_id,
 CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE 9 END AS g0, CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 12 END AS g1,
 28800 + s_suppkey % 5 * 900 AS bell_s, 3 + s_suppkey % 8 AS curb_spots, 30 + s_suppkey % 4 * 5 AS unload_s
FROM {supplier}""",
    "seed_person": """
SELECT l_linenumber AS seed, l_suppkey AS person_id, SUM(CAST(l_quantity AS BIGINT)) / (COUNT(*) * 1e0) AS base_min,
 SUM(CAST(ROUND(l_quantity * (1 - l_discount) * 100) AS BIGINT)) / (COUNT(*) * 1e2) AS plan_min
FROM {lineitem} GROUP BY l_linenumber, l_suppkey""",
    "seed_edge_bin": """
SELECT l_linenumber AS seed, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'plan' END AS variant, l_partkey % 200 AS edge_idx,
 l_suppkey % 48 AS bin, SUM(CAST(l_quantity AS BIGINT)) / 4e1 AS vc
FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "trajectory": """
SELECT trip, step, edge_idx, dwell_s, SUM(dwell_s) OVER (PARTITION BY trip ORDER BY step ROWS UNBOUNDED PRECEDING) - dwell_s AS enter_s
FROM (SELECT l_orderkey AS trip, l_partkey AS edge_idx, CAST(l_quantity AS BIGINT) * 10 AS dwell_s, ROW_NUMBER() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step FROM {lineitem}) t""",
    "curb_arrivals": """
SELECT event_id, user_id % 7 AS entrance, CAST(ts AS DATE) AS day, EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60 AS arr_s,
 CASE WHEN event_type = 'signup' THEN 4e-1 ELSE 1e0 END AS w FROM {events}""",
    "points": """
SELECT l_partkey % 200 + CAST(ROUND(l_discount * 100) AS BIGINT) % 10 / 1e1 AS x, l_suppkey + CAST(ROUND(l_tax * 100) AS BIGINT) % 10 / 1e1 AS y,
 l_quantity AS z, l_linenumber AS cls FROM {lineitem}""",
    "votes": """
SELECT event_id % 40 AS player_id, user_id % 20 AS plan_id,
 CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS value, ts, event_id FROM {events}""",
    "plans": """
SELECT o_orderkey AS plan_id, o_orderdate AS created_at, o_custkey % 30 AS author_id,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS metric_value FROM {orders}""",
    # a box around each supplier's node, sized by its key, so that boxes overlap
    "boxes": """
SELECT s.school_id AS box_id, n.x - 1.5e2 - s.school_id % 7 * 1e2 AS x0, n.x + 1.5e2 + s.school_id % 7 * 1e2 AS x1,
 n.z - 1.3e2 - s.school_id % 5 * 1e2 AS z0, n.z + 1.3e2 + s.school_id % 5 * 1e2 AS z1, CONCAT('class', CAST(s.school_id % 6 AS STRING)) AS class
FROM {schools} s JOIN {nodes} n ON n.node_id = s.node_id""",
    # homes scattered around their node
    "homes": """
SELECT h.household_id, n.x + h.household_id * 31 % 200 - 1e2 AS x, n.z + h.household_id * 53 % 200 - 1e2 AS z, h.income_band, h.vehicles
FROM {households} h JOIN {nodes} n ON n.node_id = h.home_node""",
    "seed_mode": """
SELECT l_linenumber AS seed, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'plan' END AS variant, l_suppkey AS person_id,
 CASE l_returnflag WHEN 'A' THEN 'drive_alone' WHEN 'R' THEN 'walk' ELSE 'bike' END AS mode
FROM {lineitem}""",
    "seed_school": """
SELECT seed, variant, entrance, wait_min, spill_m FROM (SELECT l_linenumber AS seed, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'plan' END AS variant,
 l_suppkey % 25 AS entrance, SUM(CAST(l_quantity AS BIGINT)) / (COUNT(*) * 1e0) AS wait_min, MAX(l_partkey % 90) * 7 AS spill_m FROM {lineitem} GROUP BY 1, 2, 3) t""",
}

# For Spark, the same rows: with the four steps in a join, a query's own condition on u and v lets it first join parts with parts by
# that condition, a nested loop over all pairs
FOR_SPARK = {
    "edges": VIEWS["edges"].replace("{part} a JOIN (VALUES (0, 1), (1, -1), (2, 40), (3, -40)) AS d(k, step) ON TRUE", "(SELECT *, INLINE(ARRAY((0, 1), (1, -1), (2, 40), (3, -40))) AS (k, step) FROM {part}) a").replace("d.k", "a.k").replace("d.step", "a.step"),
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FOR_SPARK.get(name, VIEWS[name])
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _needs(sql)})


def oracle(sql: str) -> str:
    """DuckDB SQL in which {name} stands for a table or view, with the views it needs in front."""
    views: dict[str, str] = {}

    def add(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in views:
                add(VIEWS[n])
                views[n] = VIEWS[n]

    add(sql)
    fill = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} AS ({fill(v)})" for n, v in views.items())
    body = fill(sql).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
