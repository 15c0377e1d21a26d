"""Entrances of slanted campuses against plain Python; exits, work places and scenes in their odd cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import entrances as E

RANKS = {"primary": 2, "residential": 1}


def foot(p, a, b):
    dx, dz = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dz) / (dx * dx + dz * dz)))
    return a[0] + t * dx, a[1] + t * dz


def inside(p, ring):
    odd = False
    for (ax, az), (bx, bz) in zip(ring, ring[1:]):
        if (az > p[1]) != (bz > p[1]) and p[0] < ax + (p[1] - az) * (bx - ax) / (bz - az):
            odd = not odd
    return odd


def to_ring(p, ring):
    return 0.0 if inside(p, ring) else min(math.dist(p, foot(p, a, b)) for a, b in zip(ring, ring[1:]))


def by_definition(campus, ring, core, nodes, edges, search, near):
    """Distances of segments to rings by points a tenth of a metre apart; the campuses leave more room than that."""
    def apart(e):
        a, b = nodes[e["u"]], nodes[e["v"]]
        n = int(math.dist(a, b) * 10) + 1
        return min(to_ring((a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n), ring) for k in range(n + 1))

    beside = [e for e in edges if e["highway"] in RANKS and apart(e) <= search]
    far = lambda e: round(math.dist(core, foot(core, nodes[e["u"]], nodes[e["v"]])), 6)
    own, p = [], core
    if beside:
        roads = {e["road"] for e in beside}
        name = min(roads, key=lambda r: (-max(RANKS[e["highway"]] for e in beside if e["road"] == r), min(far(e) for e in beside if e["road"] == r), r))
        own = [e for e in beside if e["road"] == name]
        least = min(own, key=lambda e: (far(e), e["edge_idx"]))
        p = foot(core, nodes[least["u"]], nodes[least["v"]])
    b = min((foot(p, x, y) for x, y in zip(ring, ring[1:])), key=lambda q: round(math.dist(p, q), 6))
    enters = {e["v"] for e in edges if e["highway"] != "motorway"}
    junctions = {n for e in own for n in (e["u"], e["v"])}
    able = [n for n in enters if to_ring(nodes[n], ring) <= (search if n in junctions else near)]
    if not able:
        return None
    node = min(able, key=lambda n: (round(math.dist(nodes[n], b), 6), n))
    into = max((e for e in edges if e["v"] == node and e["highway"] != "motorway"), key=lambda e: (e["length_m"], -e["edge_idx"]))
    return campus, node, into["edge_idx"], pytest.approx(b[0]), pytest.approx(b[1])


def test_entrances_of_slanted_campuses(spark):
    draw = random.Random(11)
    nodes = {i: (draw.uniform(0, 1500), draw.uniform(0, 1500)) for i in range(120)}
    edges = []
    for i in nodes:
        for j in sorted(nodes, key=lambda n: math.dist(nodes[i], nodes[n]))[1:4]:
            edges.append({"edge_idx": len(edges), "u": i, "v": j, "highway": draw.choice(["primary", "residential", "residential", "motorway", "service"]), "road": f"r{draw.randint(0, 15)}", "length_m": float(draw.randint(1, 4))})
    campuses = []
    for c in range(12):
        x, z, r = draw.uniform(0, 1500), draw.uniform(0, 1500), draw.uniform(20, 200)
        turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(draw.randint(3, 6)))
        ring = [(x + r * math.cos(t), z + r * math.sin(t)) for t in turns]
        campuses.append((c, ring + ring[:1], (x + 5.0, z - 3.0)))
    campuses.append((99, [(9000.0, 9000.0), (9010.0, 9000.0), (9000.0, 9010.0), (9000.0, 9000.0)], (9003.0, 9003.0)))
    shape = "campus long, ring array<struct<x: double, z: double>>, core_x double, core_z double"
    got = E.campus_entrances(
        spark.createDataFrame([(c, ring, *core) for c, ring, core in campuses], shape),
        spark.createDataFrame([(n, *p) for n, p in nodes.items()], "node_id long, x double, z double"),
        spark.createDataFrame([tuple(e.values()) for e in edges], "edge_idx long, u long, v long, highway string, road string, length_m double"),
        RANKS, ["motorway"], 150.0, 60.0,
    ).collect()
    want = [by_definition(c, ring, core, nodes, edges, 150.0, 60.0) for c, ring, core in campuses]
    assert sorted((r.campus, r.node_id, r.approach_edge, r.x, r.z) for r in got) == [w for w in want if w] and len(got) > 8


def test_exits_without_a_node(spark):
    asked = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 60.0, 0.0), (4, None, None), (5, 50.0, 0.0)], "exit_id long, x double, z double")
    snapped = spark.createDataFrame([(1, 11), (2, 12)], "exit_id long, node_id long")
    got = {tuple(r) for r in E.via_exits(snapped, asked).collect()}
    assert got == {(1, 11, None), (2, 12, None), (3, 12, 2), (5, 11, 1)}
    assert E.via_exits(snapped.limit(0), asked).collect() == []


def test_work_places(spark):
    nan = float("nan")
    persons = spark.createDataFrame(
        [(1, True, 7, 50, 0.0, 0.0), (2, True, 8, 50, 0.0, 0.0), (3, True, None, 99, 9.0, 0.0), (4, True, None, None, nan, 0.0), (5, False, None, 99, 9.0, 0.0), (6, None, 8, 99, 9.0, 0.0)],
        "person_id long, is_worker boolean, work_exit long, work_node long, work_x double, work_z double",
    )
    exits, nodes = spark.createDataFrame([(7, 51)], "exit_id long, node_id long"), spark.createDataFrame([(50, 0.0, 0.0), (51, 10.0, 0.0)], "node_id long, x2 double, z2 double")
    got = {r.person_id: (r.work_exit, r.work_node) for r in E.repaired_work(persons, exits, nodes).collect()}
    assert got == {1: (7, 51), 2: (None, 50), 3: (None, 51), 4: (None, None), 5: (None, None), 6: (None, None)}


def scenes(spark, rows):
    return spark.createDataFrame(rows, "scene string, cloud double, date string, version long")


def test_scene_ties(spark):
    pixels = spark.range(20_000).select(F.explode(F.array(*[F.struct(F.lit(s).alias("scene"), F.when(F.col("id") < n, 9).otherwise(4).alias("cls")) for s, n in [("a", 101), ("b", 100), ("c", 99), ("d", 0), ("e", 90)]])).alias("p")).select("p.*")
    few = scenes(spark, [("a", 1.0, "20260103", 0), ("b", 2.0, "20260101", 9), ("c", 3.0, "20260102", 0), ("d", 90.0, "20260109", 0)])
    assert [tuple(r) for r in E.best_scene(few, pixels, 50.0, [9]).collect()] == [("a", 101 / 20_000)]
    later = few.union(scenes(spark, [("e", 4.0, "20260101", 0)]))
    assert E.best_scene(later, pixels, 50.0, [9]).first().scene == "e"
    assert E.best_scene(later, pixels, 50.0, [9], few=3).first().scene == "a"
    assert E.best_scene(few, pixels, 0.5, [9]).collect() == []
    assert E.best_scene(scenes(spark, [("x", 1.0, "1", 0)]), pixels, 50.0, [9]).first().bad_share == 1.0
