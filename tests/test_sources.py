import json

import pytest
from pyspark.sql import functions as F

from gridmill.sources import scans as S


def test_columnar_scan_fills_optional_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.5, "x")], "id long, y double, extra string").write.parquet(path)
    df = S.columnar_scan(spark, path, {"id": "int", "label": "string"}, {"label": "none"})
    assert df.dtypes == [("id", "int"), ("label", "string")] and df.first() == (1, "none")
    with pytest.raises(ValueError):
        S.columnar_scan(spark, path, {"z": "double"})


def test_without_nan(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (float("inf"), 3)], "v double, k int")
    assert [r.v for r in S.without_nan(df).orderBy("k").collect()] == [1.0, None, None]


def test_box_scan_is_pushed_down(spark, tmp_path, capsys):
    path = str(tmp_path / "b")
    spark.range(10).select("id", F.struct(*[F.col("id").cast("double").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")]).alias("bbox")).write.parquet(path)
    df = S.box_scan(spark, path, 2.5, 2.5, 5.0, 9.0)
    assert sorted(r.id for r in df.collect()) == [3, 4, 5]
    df.explain("formatted")
    assert "LessThanOrEqual(bbox.xmin" in capsys.readouterr().out


def test_schools_and_features(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "name": "A", "grades": [1, 2], "entrances": [{"id": "e1", "x": 1.0}, {"id": "e2"}]}, {"id": "b", "name": "B", "entrances": []}]))
    assert sorted((r.id, r.entrance_id) for r in S.schools_scan(spark, str(tmp_path / "s.json")).collect()) == [("a", "e1"), ("a", "e2"), ("b", None)]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"id": "1", "h": 3.0}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"h": 1.0}, "geometry": None}]}))
    rows = S.features_scan(spark, str(tmp_path / "f.json"), "id:string,h:double").collect()
    assert [(r.id, r.h) for r in rows] == [("1", 3.0)]


def test_od_and_census(spark, tmp_path):
    (tmp_path / "od.csv").write_text("w_geocode,h_geocode,S000\n60730001001000,60730002001000,3\n60730001001000,60990002001000,4\n")
    assert [tuple(r) for r in S.od_scan(spark, str(tmp_path / "od.csv"), "06073").collect()] == [("060730002001000", "060730001001000", 3)]
    (tmp_path / "c.json").write_text(json.dumps([["B1_E", "state", "county", "tract", "block group"], ["12", "06", "073", "000100", "1"], ["-666666666", "06", "073", "000100", "2"]]))
    got = {r.geoid: r.value for r in S.census_rows(spark, str(tmp_path / "c.json"), ["B1_E"]).collect()}
    assert got == {"060730001001": 12.0, "060730001002": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [(0.0, 0.004), (1.0, 0.0), (0.0, 0.0)], None)], "id string, ring array<struct<x:double,z:double>>, note string")
    S.write_features(df, str(tmp_path / "g"), "ring")
    line = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert line["properties"] == {"id": "a"} and line["geometry"]["coordinates"][0][0] == [0.0, 0.0]
    S.write_contract(df, str(tmp_path / "c"), {"id": "string"})
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["id"]
    pts = spark.createDataFrame([(10.0, 999.9), (1000.0, 0.0)], "x double, y double")
    S.write_tiles(pts, str(tmp_path / "t"))
    assert {(r.ckm, r.rkm) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(0, 0), (1, 0)}


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("0-0-0-0", 5), ("1-0-0-0", 3), ("1-1-1-0", 3), ("1-1-0-0", 0)], "key string, count long")
    assert sorted(r.key for r in S.hierarchy_select(nodes, (0, 0, 100), (0, 0, 40, 40)).collect()) == ["0-0-0-0", "1-0-0-0"]
