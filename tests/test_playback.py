"""Playback files: what is written comes back, and broken files say so."""

import json
import struct

import numpy as np
import pytest

from gridmill.sources import playback as P


def a_file(sections, head=None, magic=b"RDPB", version=1, offset=0):
    """A file made by hand."""
    listed, body = [], bytes(offset)
    for name, kind, values in sections:
        listed.append({"name": name, "dtype": kind, "offset": len(body), "count": len(values)})
        body += np.array(values, dtype={"float32": "<f4", "uint32": "<u4", "int32": "<i4", "float64": "<f8"}[kind]).tobytes()
    text = json.dumps({"plan_id": "p", "seed": 3, "n_bins": 2, "n_edges": 2, "entrance_ids": ["a"], "sections": listed} | (head or {})).encode()
    return magic + struct.pack("<II", version, len(text)) + text + bytes(-(12 + len(text)) % 4) + body


WAYS = [("traj_offsets", "uint32", [0, 2, 2, 3]), ("traj_kind", "uint32", [1, 4, 2]), ("traj_edge", "int32", [5, -1, 7]), ("traj_enter_s", "float32", [0, 1.5, 9]), ("traj_exit_s", "float32", [1.5, 2, 10])]
LOADS = [("later_invention", "float64", [1, 2, 3]), ("edge_speed_kph", "float32", [10, 20, 30, 40]), ("edge_vc", "float32", [0.5, 0, 1, 2]), ("queue_len", "float32", [3, 4])]


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "files"
    at.mkdir()
    (at / "good").write_bytes(a_file(LOADS + WAYS))
    (at / "bad-magic").write_bytes(a_file(LOADS, magic=b"NOPE"))
    (at / "bad-version").write_bytes(a_file(LOADS, version=2))
    (at / "bad-json").write_bytes(b"RDPB" + struct.pack("<II", 1, 4) + b"{,]}")
    (at / "cut").write_bytes(a_file(LOADS + WAYS)[:-6])
    (at / "empty").write_bytes(b"")
    (at / "misfit").write_bytes(a_file([*WAYS[:1], ("traj_kind", "uint32", [1]), *WAYS[2:]]))
    (at / "odd").write_bytes(a_file(LOADS + WAYS, offset=2))
    (at / "_ignored").write_bytes(b"x")
    return str(at)


def test_tables_of_files(spark, folder):
    P.register(spark)
    for read, seen in ((lambda t: P.playback_scan(spark, f"file://{folder}", t), set()), (lambda t: spark.read.format("playback").option("table", t).load(folder), {"empty"})):
        ways = read("trajectories").collect()
        assert sorted((r.trajectory, r.kind, r.step, r.edge, r.enter_s, r.exit_s) for r in ways if r.file == "good") == [(0, 1, 0, 5, 0, 1.5), (0, 1, 1, -1, 1.5, 2), (2, 2, 0, 7, 9, 10)]
        errors = {r.file: r.error for r in ways if r.error}
        assert errors.keys() == {"bad-magic", "bad-version", "bad-json", "cut", "misfit", "odd"} | seen
        assert "version 2" in errors["bad-version"] and "fit" in errors["misfit"] and "four" in errors["odd"]
        edges = [r for r in read("edges").collect() if r.file == "good"]
        assert sorted((r.bin, r.edge, r.vc, r.speed_kph, r.plan_id, r.seed) for r in edges) == [(0, 0, 0.5, 10, "p", 3), (0, 1, 0, 20, "p", 3), (1, 0, 1, 30, "p", 3), (1, 1, 2, 40, "p", 3)]
        assert sorted((r.bin, r.entrance_id, r.queue_len) for r in read("queues").collect() if r.file == "good") == [(0, "a", 3), (1, "a", 4)]


def test_a_partition_a_file(spark, folder):
    P.register(spark)
    assert spark.read.format("playback").load(folder).rdd.getNumPartitions() == 8


def rows(spark, names):
    edges = spark.createDataFrame([(n, 1, 0, 0.25, 30.0) for n in names], "file string, bin int, edge int, vc double, speed_kph double")
    queues = spark.createDataFrame([(names[0], 0, "b", 2.0)], "file string, bin int, entrance_id string, queue_len double")
    points = spark.createDataFrame([(n, t, 1, s, t + s, 1.0 * s, 2.0 * s) for n in names for t in (9, 4) for s in (1, 2)], "file string, trip long, kind int, step int, edge int, enter_s double, exit_s double")
    return P.playback_rows(edges, queues, points, 2, 3, ["a", "b"], 0, 300)


def test_round_trip_and_modes(spark, tmp_path):
    P.register(spark)
    path = str(tmp_path / "out")
    write = lambda names, mode: rows(spark, names).write.format("playback").mode(mode).option("path", path).save()
    write(["p-1", "p-2"], "append")
    write(["p-3"], "append")
    read = lambda t: spark.read.format("playback").option("table", t).load(path).collect()
    edges = read("edges")
    assert len(edges) == 3 * 6 and {(r.file, r.seed) for r in edges} == {("p-1", 1), ("p-2", 2), ("p-3", 3)} and sum(r.vc for r in edges) == 0.75
    assert [(r.bin, r.entrance_id) for r in read("queues") if r.queue_len] == [(0, "b"), (0, "b")]
    assert sorted((r.trajectory, r.step, r.edge) for r in read("trajectories") if r.file == "p-2") == [(0, 0, 5), (0, 1, 6), (1, 0, 10), (1, 1, 11)]
    write(["p-9"], "overwrite")
    assert {r.file for r in read("edges")} == {"p-9"}


def test_nothing_is_put_in_place_by_a_failed_write(spark, tmp_path):
    P.register(spark)
    good = rows(spark, ["p-1"])
    for bad in (good.withColumn("file", P.F.lit("../x")), good.withColumn("n_edges", P.F.lit(9)), good.union(good)):
        with pytest.raises(Exception, match="file name|numbers"):
            good.withColumn("file", P.F.lit("p-5")).union(bad).write.format("playback").mode("append").option("path", str(tmp_path)).save()
    assert not [f for f in tmp_path.iterdir() if not f.name.startswith(".")]
