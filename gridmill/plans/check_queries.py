"""Queries that check tools and estimates given as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import checks as K
from gridmill.plans.views import table
from gridmill.registry import query

_SPECS = [
    ("bell", 0, "school", "school", True, None, None, None, None, None, True),
    ("bell", 1, "start", "time", False, "08:30", "07:30", "09:30", None, None, False),
    ("bell", 2, "note", "text", False, None, None, None, None, 12, False),
    ("curb", 0, "spots", "int", True, None, "0", "40", None, None, False),
    ("curb", 1, "side", "select", False, "left", None, None, ["left", "right"], None, False),
    ("curb", 2, "paid", "bool", False, None, None, None, None, None, False),
    ("road", 0, "edge", "edge", False, None, None, None, None, None, False),
    ("road", 1, "at", "point", False, None, None, None, None, None, False),
    ("road", 2, "line", "polyline", False, None, None, None, None, None, False),
]


@query("""
WITH t AS (SELECT o_orderkey AS k, o_orderkey % 3 AS tool, o_custkey AS c FROM {orders}), s AS (SELECT COUNT(*) AS n FROM {schools}), e AS (SELECT edge_idx FROM {edges})
SELECT k AS plan_id, CASE tool
 WHEN 0 THEN CASE WHEN c % 11 = 0 THEN 'missing required parameter ''school''' WHEN c % 11 > 1 AND c % 300 >= s.n THEN 'unknown school ''' || CAST(c % 300 AS VARCHAR) || ''''
  WHEN k % 26 >= 24 THEN '''start'' must be a time HH:MM' WHEN k % 26 < 8 THEN '''start'' ' || LPAD(CAST(k % 26 AS VARCHAR), 2, '0') || ':15 is earlier than 07:30' WHEN k % 26 > 9 THEN '''start'' ' || CAST(k % 26 AS VARCHAR) || ':15 is later than 09:30'
  WHEN k % 5 = 0 THEN '''note'' is longer than 12 characters' END
 WHEN 1 THEN CASE c % 6 WHEN 0 THEN '''spots'' must be a number' WHEN 1 THEN '''spots'' must be a whole number' ELSE CASE WHEN c % 60 > 40 THEN '''spots'' must be <= 40' WHEN k % 4 = 0 THEN '''side'' must be one of left, right' WHEN k % 7 = 0 THEN '''paid'' must be true or false' END END
 ELSE CASE WHEN k % 10 < 8 AND k % 1000 NOT IN (SELECT edge_idx FROM e) THEN 'edge ' || CAST(k % 1000 AS VARCHAR) || ' does not exist' WHEN k % 10 = 9 THEN '''edge'' must be [lat, lon]' WHEN c % 4 = 0 THEN '''at'' must be [lat, lon]' WHEN c % 4 = 1 THEN '''line'' needs at least 2 points' END END AS error,
 CASE WHEN k % 13 = 0 THEN 'colour' ELSE '' END AS unknown FROM t, s""")
def tool_param_validation(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('"'))
    pair = lambda name, v: F.concat(F.lit(f'"{name}": '), v)
    more = F.when(k % 13 == 0, pair("colour", F.lit("1")))
    bell = [F.when(c % 11 != 0, pair("school", F.when(c % 11 == 1, text(F.lit("ALL"))).otherwise(text(c % 300)))), pair("start", text(F.concat(F.lpad((k % 26).cast("string"), 2, "0"), F.lit(":15")))), F.when(k % 5 == 0, pair("note", text(F.lit("far too long a note"))))]
    curb = [pair("spots", F.when(c % 6 == 0, text(F.lit("many"))).when(c % 6 == 1, F.lit("2.5")).otherwise((c % 60).cast("string"))), F.when(k % 4 == 0, pair("side", text(F.lit("top")))), F.when(k % 7 == 0, pair("paid", F.lit("3"))).when(k % 7 == 1, pair("paid", F.lit("true")))]
    road = [pair("edge", F.when(k % 10 == 8, F.lit("[33.0, -117.1]")).when(k % 10 == 9, F.lit("[95, 0]")).otherwise((k % 1000).cast("string"))), F.when(c % 4 == 0, pair("at", F.lit('[1, "x"]'))).when(c % 4 == 2, pair("at", F.lit('{"lat": 3, "lon": 4}'))), F.when(c % 4 == 1, pair("line", F.lit("[[1, 2]]"))).when(c % 4 == 3, pair("line", F.lit("[[1, 2], [3, 4]]")))]
    params = lambda parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts, more), F.lit("}"))
    tools = table(spark, sf_dir, "orders").select(k.alias("plan_id"), F.lit(0).alias("pos"), F.when(k % 3 == 0, "bell").when(k % 3 == 1, "curb").otherwise("road").alias("tool"), F.when(k % 3 == 0, params(bell)).when(k % 3 == 1, params(curb)).otherwise(params(road)).alias("params"))
    there = table(spark, sf_dir, "schools").select(F.lit("school").alias("kind"), F.col("school_id").cast("string").alias("value")).union(table(spark, sf_dir, "edges").select(F.lit("edge"), F.col("edge_idx").cast("string")))
    out = K.tool_errors(tools, spark.createDataFrame(_SPECS, K.SPEC), there)
    return out.select("plan_id", "error", F.array_join("unknown", ",").alias("unknown"))


@query("""
WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM {orders})
SELECT k AS plan_id, CASE WHEN k % 10 > c % 10 THEN 'adoption_range must be [low, high] with 0 <= low <= high <= 1'
 WHEN k % 4 = 0 THEN 'mode ''drive_alone'' is not a choice for students' WHEN k % 4 = 1 AND c % 8 > 5 THEN 'utility shift for bike exceeds 2.5' WHEN k % 4 = 1 AND c % 400 NOT IN (SELECT school_id FROM {schools}) THEN 'unknown school ''' || CAST(c % 400 AS VARCHAR) || ''''
 WHEN k % 3 = 0 THEN 'capacity factor 9.0 outside [0.5, 2.0]' WHEN c % 900 NOT IN (SELECT edge_idx FROM {edges}) THEN 'edge ' || CAST(c % 900 AS VARCHAR) || ' does not exist' END AS error FROM t""")
def estimate_levers(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    lever = lambda **v: F.struct(*[v.get(n, none(t)).cast(t).alias(n) for n, t in (("type", "string"), ("mode", "string"), ("applies_to", "string"), ("utils", "double"), ("school", "string"), ("target", "string"), ("edge_idx", "long"), ("entrance", "string"), ("factor", "double"))])
    shift = F.when(k % 4 == 0, lever(type=F.lit("shift"), mode=F.lit("drive_alone"), applies_to=F.lit("students"), utils=F.lit(0.1))).otherwise(
        lever(type=F.lit("shift"), mode=F.lit("bike"), applies_to=F.lit("all"), utils=F.when(k % 4 == 1, c % 8 * 0.5).otherwise(-1.0), school=F.when(k % 4 == 1, (c % 400).cast("string")))
    )
    room = lever(type=F.lit("capacity"), target=F.lit("edge"), edge_idx=c % 900, factor=F.when(k % 3 == 0, 9.0).otherwise(1.5))
    estimate = F.to_json(F.struct(F.array(shift, room).alias("levers"), F.array(k % 10 / 10.0, c % 10 / 10.0).alias("adoption_range")))
    rows = table(spark, sf_dir, "orders").select(k.alias("plan_id"), estimate.alias("estimate"))
    there = table(spark, sf_dir, "schools").select(F.lit("school").alias("kind"), F.col("school_id").cast("string").alias("value")).union(table(spark, sf_dir, "edges").select(F.lit("edge"), F.col("edge_idx").cast("string")))
    return K.lever_errors(rows, there, 2.5, (0.5, 2.0))
