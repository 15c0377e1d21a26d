"""Readers and writers, each as a round trip: tables go out in a format through the shared folder and come back by a scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridmill.operators import spatial as P
from gridmill.operators.network import shared_folder
from gridmill.plans.views import table
from gridmill.registry import query
from gridmill.sources import playback
from gridmill.sources import scans as S


def _place(spark, name):
    return f"{shared_folder(spark)}/round-trips/{uuid.uuid4().hex}/{name}"


def _documents(df, by, path):
    """A text file with one document for each row of (by, value)."""
    df.write.partitionBy(by).text(path)
    return path


@query("SELECT box_id FROM {boxes} WHERE x0 <= 4e3 AND x1 >= 1e3 AND z0 <= 3e3 AND z1 >= 5e2")
def bbox_pruned_scan(spark, sf_dir):
    """Nested boxes are compared in the scan, where parquet's statistics prune."""
    box = F.struct(F.col("x0").alias("xmin"), F.col("x1").alias("xmax"), F.col("z0").alias("ymin"), F.col("z1").alias("ymax"))
    path = _place(spark, "boxes")
    table(spark, sf_dir, "boxes").select("box_id", box.alias("bbox")).write.parquet(path)
    return S.box_scan(spark, path, 1e3, 5e2, 4e3, 3e3).select("box_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN k.k < s_suppkey % 3 THEN CAST(s_suppkey AS VARCHAR) || '/' || CAST(k.k AS VARCHAR) END AS entrance_id, CASE WHEN k.k < s_suppkey % 3 THEN s_acctbal END AS x FROM {supplier} JOIN (SELECT UNNEST(RANGE(2)) AS k) k ON k.k < s_suppkey % 3 OR k.k = 0")
def json_document_scan(spark, sf_dir):
    """A document of schools for each nation; schools without an entrance keep one row."""
    k = F.col("s_suppkey")
    door = lambda i: F.struct(F.concat(k.cast("string"), F.lit("/"), i.cast("string")).alias("id"), F.col("s_acctbal").alias("x"))
    school = F.struct(k.cast("string").alias("id"), F.col("s_name").alias("name"), F.filter(F.array(F.when(k % 3 > 0, door(F.lit(0))), F.when(k % 3 > 1, door(F.lit(1)))), lambda d: d.isNotNull()).alias("entrances"))
    docs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(school)).alias("value"))
    return S.schools_scan(spark, _documents(docs, "s_nationkey", _place(spark, "schools"))).select("id", "name", "entrance_id", "x")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS balance FROM {supplier} WHERE s_suppkey % 4 > 0")
def geojson_feature_scan(spark, sf_dir):
    """A FeatureCollection for each nation; features without an id go."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey").cast("string")).alias("id"), F.col("s_acctbal").alias("balance")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey"), F.lit(0)).alias("coordinates")).alias("geometry"))
    docs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    return S.features_scan(spark, _documents(docs, "s_nationkey", _place(spark, "features")), "id:string,balance:double").select("id", "balance")


@query("SELECT LPAD(CAST(6073 * CAST(10000000000 AS BIGINT) + o_orderkey AS VARCHAR), 15, '0') AS h_geocode, LPAD(CAST(o_custkey AS VARCHAR), 15, '0') AS w_geocode, o_orderkey % 9 AS jobs FROM {orders} WHERE o_orderkey % 3 = 0")
def prefix_filtered_csv_scan(spark, sf_dir):
    """Blocks lose their leading zeros on the way out and get them back."""
    county = F.when(F.col("o_orderkey") % 3 == 0, 6073).otherwise(6099).cast("long")
    path = _place(spark, "od")
    rows = table(spark, sf_dir, "orders").select((county * 10_000_000_000 + F.col("o_orderkey")).alias("h_geocode"), F.col("o_custkey").alias("w_geocode"), F.lit("x").alias("other"), (F.col("o_orderkey") % 9).alias("S000"))
    rows.write.option("header", True).csv(path)
    return S.od_scan(spark, path, "06073")


@query("SELECT '06' || LPAD(CAST(s_nationkey AS VARCHAR), 3, '0') || LPAD(CAST(s_suppkey AS VARCHAR), 6, '0') || '1' AS geoid, c AS \"column\", CASE c WHEN 'B1' THEN CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey * 2 AS DOUBLE) END ELSE CASE WHEN s_suppkey % 4 > 0 THEN 7e0 END END AS value FROM {supplier} CROSS JOIN (SELECT UNNEST(['B1', 'B2']) AS c) c")
def census_rows_to_table(spark, sf_dir):
    """An answer with a header row for each nation; sentinels and words are null."""
    k = F.col("s_suppkey")
    row = F.array(F.when(k % 5 == 0, "-666666666").otherwise((k * 2).cast("string")), F.when(k % 4 == 0, "n/a").otherwise("7"), F.lit("06"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lpad(k.cast("string"), 6, "0"), F.lit("1"))
    head = F.array(F.array(*[F.lit(c) for c in ("B1", "B2", "state", "county", "tract", "block group")]))
    docs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.concat(head, F.collect_list(row))).alias("value"))
    return S.census_rows(spark, _documents(docs, "s_nationkey", _place(spark, "census")), ["B1", "B2"])


@query("SELECT CAST(edge_idx AS INTEGER) AS edge_idx, CAST(lanes AS SMALLINT) AS lanes, CAST(length_m AS FLOAT) AS length_m, name FROM {edges}")
def contract_parquet_sink(spark, sf_dir):
    path = _place(spark, "edges")
    S.write_contract(table(spark, sf_dir, "edges"), path, {"edge_idx": "int", "lanes": "smallint", "length_m": "float", "name": "string"})
    out = spark.read.parquet(path)
    if [t for _, t in out.dtypes] != ["int", "smallint", "float", "string"]:
        raise ValueError(f"the contract isn't kept: {out.dtypes}")
    return out


@query("SELECT box_id AS id, CASE WHEN box_id % 2 = 0 THEN class END AS note, ROUND(x1, 1) AS x1, ROUND(z1, 1) AS z1 FROM {boxes}")
def geojson_sink(spark, sf_dir):
    """One feature a line, rounded; the properties that are null are left out."""
    path = _place(spark, "boxes")
    rows = table(spark, sf_dir, "boxes").select(F.col("box_id").alias("id"), F.when(F.col("box_id") % 2 == 0, F.col("class")).alias("note"), P.box_ring(F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1")).alias("ring"))
    S.write_features(rows, path, "ring", 1)
    read = F.from_json("value", "properties struct<id: long, note: string>, geometry struct<coordinates: array<array<array<double>>>>")
    corner = F.element_at(F.element_at(F.col("f.geometry.coordinates"), 1), 3)
    return spark.read.text(path).select(read.alias("f")).select("f.properties.*", F.element_at(corner, 1).alias("x1"), F.element_at(corner, 2).alias("z1"))


_NODE = "SELECT p_partkey AS id, p_size % 5 AS depth, p_partkey % CAST(POW(2, p_size % 5) AS BIGINT) AS x, p_partkey * 3 % CAST(POW(2, p_size % 5) AS BIGINT) AS y, p_partkey % 7 AS n FROM {part}"


@query(f"SELECT id FROM ({_NODE}) t WHERE n > 0 AND x * 1e3 / POW(2, depth) <= 4e2 AND (x + 1) * 1e3 / POW(2, depth) >= 1.5e2 AND y * 1e3 / POW(2, depth) <= 9e2 AND (y + 1) * 1e3 / POW(2, depth) >= 3e2")
def octree_node_select(spark, sf_dir):
    rows = spark.sql(_NODE, part=table(spark, sf_dir, "part"))
    nodes = rows.select("id", F.concat_ws("-", "depth", "x", "y", F.lit("0")).alias("key"), F.col("n").alias("count"))
    return S.hierarchy_select(nodes, (0.0, 0.0, 1000.0), (150.0, 300.0, 400.0, 900.0)).select("id")


_SPEED = "CAST(6e1 / (1 + vc) AS DOUBLE)"
_LOADS = f"SELECT CONCAT(variant, '-', CAST(seed AS STRING), '-loads') AS file, bin, edge_idx AS edge, vc, {_SPEED} AS speed_kph FROM {{seed_edge_bin}}"
_WAITS = "SELECT CONCAT(variant, '-', CAST(seed AS STRING), '-loads') AS file, entrance * 7 % 48 AS bin, CONCAT('e', CAST(entrance AS STRING)) AS entrance_id, wait_min * 1e0 AS queue_len FROM {seed_school}"
_POINTS = "SELECT CONCAT('trips-', CAST(CAST(FLOOR(trip / 4096.0) AS BIGINT) AS STRING)) AS file, trip, trip % 5 AS kind, step, edge_idx AS edge, enter_s, enter_s + dwell_s AS exit_s FROM {trajectory}"


@query(f"""
WITH l AS ({_LOADS.replace('STRING', 'VARCHAR')}), w AS ({_WAITS.replace('STRING', 'VARCHAR')}), p AS ({_POINTS.replace('STRING', 'VARCHAR')}),
t AS (SELECT file, DENSE_RANK() OVER (PARTITION BY file ORDER BY trip) - 1 AS a, step - 1 AS b, kind, edge, enter_s, exit_s FROM p)
SELECT 'edges' AS part, file, CAST(bin AS BIGINT) AS a, CAST(edge AS VARCHAR) AS b, ROUND(CAST(CAST(vc AS FLOAT) AS DOUBLE), 3) AS v, ROUND(CAST(CAST(speed_kph AS FLOAT) AS DOUBLE), 3) AS w FROM l
UNION ALL SELECT 'queues', file, bin, entrance_id, ROUND(CAST(CAST(queue_len AS FLOAT) AS DOUBLE), 3), NULL FROM w
UNION ALL SELECT 'trajectories', file, a, b || '/' || kind || '/' || edge, ROUND(CAST(CAST(enter_s AS FLOAT) AS DOUBLE), 3), ROUND(CAST(CAST(exit_s AS FLOAT) AS DOUBLE), 3) FROM t""")
def playback_files_to_tables(spark, sf_dir):
    """Loads and queues of every run and the trajectories, 4,096 trip numbers a file, written as playback files and read back; cells without load are dense zeros in the files and left out here."""
    view = lambda name, sql: spark.sql(sql, **{name: table(spark, sf_dir, name)})
    rows = playback.playback_rows(view("seed_edge_bin", _LOADS), view("seed_school", _WAITS), view("trajectory", _POINTS), 48, 200, [f"e{k}" for k in range(25)], 25200, 300)
    path = _place(spark, "playback")
    playback.register(spark)
    rows.write.format("playback").mode("append").option("path", path).save()
    read = lambda name: spark.read.format("playback").option("table", name).load(path).where("error is null")
    number = lambda c: F.round(F.col(c), 3)
    none = F.lit(None).cast("double")
    edges = read("edges").where("vc <> 0").select(F.lit("edges").alias("part"), "file", F.col("bin").cast("long").alias("a"), F.col("edge").cast("string").alias("b"), number("vc").alias("v"), number("speed_kph").alias("w"))
    queues = read("queues").where("queue_len <> 0").select(F.lit("queues"), "file", F.col("bin").cast("long"), "entrance_id", number("queue_len"), none)
    return edges.union(queues).union(read("trajectories").select(F.lit("trajectories"), "file", "trajectory", F.concat_ws("/", "step", "kind", "edge"), number("enter_s"), number("exit_s")))
