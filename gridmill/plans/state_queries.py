"""Queries over plans, votes and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import state as S
from gridmill.plans.views import table
from gridmill.registry import query

_LAST = "SELECT plan_id, player_id, ARG_MAX(value, ROW(ts, event_id)) AS value FROM {votes} GROUP BY plan_id, player_id"


@query(f"WITH l AS ({_LAST}) SELECT p.plan_id, COALESCE(SUM(value), 0) AS votes FROM {{plans}} p LEFT JOIN l ON l.plan_id = p.plan_id GROUP BY p.plan_id")
def vote_total(spark, sf_dir):
    return S.vote_totals(table(spark, sf_dir, "plans"), table(spark, sf_dir, "votes"))


@query("SELECT plan_id, metric_value, (SELECT COUNT(*) FROM {plans}) AS total FROM {plans} ORDER BY metric_value DESC NULLS LAST, created_at DESC, plan_id LIMIT 20 OFFSET 40")
def plan_listing(spark, sf_dir):
    return S.list_plans(table(spark, sf_dir, "plans"), "metric", 20, 40).select("plan_id", "metric_value", "total")


@query("SELECT conv_id, turn, role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM {conversations}) t WHERE r <= 3")
def latest_row(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return S.latest(rows, ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")], 3).select("conv_id", "turn", "role")


@query("SELECT plan_id, MIN(event_id) AS event_id FROM {votes} GROUP BY plan_id")
def distinct_first_seen(spark, sf_dir):
    return S.first_seen(table(spark, sf_dir, "votes"), "plan_id", ["event_id"])


@query("SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.v, b.v) AS v FROM (SELECT s_suppkey AS k, NULLIF(s_acctbal, 0) AS v FROM {supplier} WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey * 1e0 AS v FROM {supplier} WHERE s_suppkey % 3 = 0) b ON a.k = b.k")
def priority_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    first = rows.where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS k", "nullif(s_acctbal, 0) AS v")
    return S.priority_merge(first, rows.where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS k", "s_nationkey * 1e0 AS v"), "k")


@query("SELECT COUNT(*) FILTER (WHERE a.node_id IS NOT NULL AND b.node_id IS NOT NULL) AS shared, COUNT(*) FILTER (WHERE a.x <> b.x) AS moved, COUNT(*) FILTER (WHERE b.node_id IS NULL) AS gone, COUNT(*) FILTER (WHERE a.node_id IS NULL) AS added FROM (SELECT * FROM {nodes} WHERE node_id % 7 > 0) a FULL JOIN (SELECT node_id, x + CASE WHEN node_id % 5 = 0 THEN 1 ELSE 0 END AS x FROM {nodes} WHERE node_id % 11 > 0) b ON a.node_id = b.node_id")
def id_intersection_diff(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes")
    moved = nodes.where("node_id % 11 > 0").withColumn("x", F.col("x") + F.when(F.col("node_id") % 5 == 0, 1).otherwise(0))
    return S.id_changes(nodes.where("node_id % 7 > 0"), moved, "node_id", 0.5)


@query("SELECT l_orderkey AS plan_id, SUM(CAST(l_quantity AS BIGINT)) AS upfront, SUM(l_linenumber) AS yearly, SUM(CAST(l_quantity AS BIGINT)) > 150 OR SUM(l_linenumber) > 20 AS over_budget FROM {lineitem} GROUP BY l_orderkey")
def plan_budget(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS plan_id", "CAST(l_quantity AS BIGINT) AS upfront", "l_linenumber AS yearly")
    return S.budgets(lines, 150, 20)


@query("""
WITH r AS (SELECT seed, person_id, base_min, plan_min FROM {seed_person})
SELECT person_id AS plan_id, goal, CASE WHEN v IS NULL THEN 'unknown' WHEN goal = 'short' AND v <= 25 OR goal = 'long' AND v >= 24 THEN 'met' ELSE 'missed' END AS status
FROM (SELECT p.person_id, g.goal, (SELECT MAX(CASE g.goal WHEN 'short' THEN base_min ELSE plan_min END) FROM r WHERE r.person_id = p.person_id AND r.seed = g.seed) AS v FROM (SELECT DISTINCT person_id FROM r) p CROSS JOIN (VALUES ('short', 1), ('long', 2), ('none', 99)) AS g(goal, seed)) t""")
def goal_scoring(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_person")
    reports = rows.where("seed = 1").selectExpr("person_id AS plan_id", "'base' AS metric", "base_min AS value").union(rows.where("seed = 2").selectExpr("person_id", "'plan'", "plan_min")).union(rows.selectExpr("person_id", "'other'", "0e0"))
    goals = spark.createDataFrame([("short", "base", "at_most", 25.0), ("long", "plan", "at_least", 24.0), ("none", "absent", "at_most", 0.0)], "goal string, metric string, kind string, target double")
    return S.goal_status(reports, goals)


@query("SELECT plan_id, ARRAY_TO_STRING(LIST(k || '=' || CAST(v AS BIGINT) ORDER BY k), ';') AS headline FROM (SELECT person_id AS plan_id, 'm' || CAST(seed AS VARCHAR) AS k, FLOOR(MEDIAN(base_min)) AS v FROM {seed_person} GROUP BY 1, 2) t GROUP BY plan_id")
def headline_map(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_person").groupBy(F.col("person_id").alias("plan_id"), F.concat(F.lit("m"), F.col("seed").cast("string")).alias("metric")).agg(F.floor(F.percentile("base_min", F.lit(0.5))).alias("median"))
    return S.metric_map(rows).select("plan_id", F.array_join(F.transform(F.map_entries("headline"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("headline"))


@query()
def content_fingerprint(spark, sf_dir):
    return S.fingerprint(table(spark, sf_dir, "orders"))
