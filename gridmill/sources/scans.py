"""Scans and sinks with an exact type contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.operators.network import shared_folder
from gridmill.operators.report import finite


def cached_extract(spark: SparkSession, folder: str, key: dict, read: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """An extract under its key (release, box rounded to 6 digits, columns, ...): read once, written with zstd, and reused while the key stays.

    Keys with floats count to 6 digits. An extract counts as there when its
    write was completed (Spark's _SUCCESS mark).
    """
    def rounded(v):
        return round(v, 6) if isinstance(v, float) else [rounded(x) for x in v] if isinstance(v, (list, tuple)) else v

    text = json.dumps({k: rounded(v) for k, v in key.items()}, sort_keys=True)
    path = f"{folder.rstrip('/')}/key={hashlib.sha256(text.encode()).hexdigest()[:32]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)
    if force or not there:
        read().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def columnar_scan(spark: SparkSession, path: str, columns: dict[str, str], defaults: dict | None = None) -> DataFrame:
    """The given columns (name: type) of a parquet table; absent optional ones take their default."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns and c not in (defaults or {})]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(defaults[c])).cast(kind).alias(c) for c, kind in columns.items()])


def _finite(c, kind: T.DataType):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating number as null, in structs and arrays too."""
    return df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def box_scan(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features whose bbox struct meets the box; the comparison of nested fields is pushed to parquet."""
    return spark.read.parquet(path).where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south))


def schools_scan(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entrance of each school of a JSON document; schools without entrances keep one row."""
    entrance = "array<struct<id:string,x:double,z:double,node_id:bigint,approach_edge_idx:int,curb_spots:int,unload_seconds:double>>"
    schema = f"id string, name string, grades array<int>, bell_start string, x double, z double, students int, entrances {entrance}"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("id", "name", "grades", "bell_start", F.explode_outer("entrances").alias("e")).select("id", "name", "grades", "bell_start", F.col("e.id").alias("entrance_id"), "e.x", "e.z", "e.node_id", "e.curb_spots", "e.unload_seconds")


def features_scan(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON documents with an id: properties (a DDL list) and the geometry as JSON."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.to_json("f.geometry").alias("geometry")).where("id is not null")


def od_scan(spark: SparkSession, path: str, county: str) -> DataFrame:
    """Origin-destination rows whose home block starts with the county code; three columns."""
    rows = spark.read.option("header", True).csv(path).select("h_geocode", "w_geocode", F.col("S000").cast("long").alias("jobs"))
    pad = lambda c: F.lpad(c, 15, "0").alias(c)
    return rows.select(pad("h_geocode"), pad("w_geocode"), "jobs").where(F.col("h_geocode").startswith(county))


def census_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Census answers (a JSON array of arrays with a header) as long rows: geoid, column, value; negative values are null."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    body = doc.select(F.element_at("rows", 1).alias("head"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row"))
    at = lambda name: F.element_at("row", F.array_position("head", name).cast("int"))
    geoid = F.concat(*[at(c) for c in ("state", "county", "tract", "block group")])
    value = lambda c: F.expr(f"try_cast(element_at(row, cast(array_position(head, '{c}') as int)) as double)")
    return body.select(geoid.alias("geoid"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(value(c) >= 0, value(c)).alias("value")) for c in columns])))


def write_contract(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Write with exactly these columns and types."""
    df.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns.items()]).write.mode("overwrite").parquet(path)


def write_features(df: DataFrame, path: str, geometry: str, digits: int = 2) -> None:
    """Write one GeoJSON feature a line. geometry: an array<struct<x,z>> ring; null properties are left out."""
    ring = F.transform(geometry, lambda p: F.array(F.round(p["x"], digits), F.round(p["z"], digits)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*[c for c in df.columns if c != geometry]).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_tiles(points: DataFrame, path: str, size: float = 1000.0) -> None:
    """Write points in aligned half-open tiles, a folder each."""
    placed = points.withColumn("ckm", F.floor(F.col("x") / size)).withColumn("rkm", F.floor(F.col("y") / size))
    placed.repartition("ckm", "rkm").write.mode("overwrite").partitionBy("ckm", "rkm").parquet(path)


def hierarchy_select(nodes: DataFrame, root: tuple[float, float, float], box: tuple[float, float, float, float]) -> DataFrame:
    """Nodes 'depth-x-y-z' of an octree with points whose square meets the box (x0, y0, x1, y1). root: x, y, size."""
    part = F.split("key", "-")
    side = F.lit(root[2]) / F.pow(F.lit(2.0), F.get(part, 0).cast("int"))
    x, y = (F.lit(root[i]) + F.get(part, i + 1).cast("int") * side for i in (0, 1))
    return nodes.where(F.col("count") > 0).where((x <= box[2]) & (x + side >= box[0]) & (y <= box[3]) & (y + side >= box[1]))
