"""New operators against plain Python versions on the small tables."""

import heapq
import math
import time

import pytest
from pyspark.sql import functions as F

from gridmill.functions import rules as R
from gridmill.functions import scalars as S
from gridmill.functions import tags as T
from gridmill.operators import lines as L
from gridmill.operators import network as N
from gridmill.operators import population as P
from gridmill.operators import skims as K
from gridmill.operators import world as O
from gridmill.plans import network_queries as Q
from gridmill.plans.views import table

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def dijkstra(edges, anchor):
    into = {}
    for e in edges:
        into.setdefault(e.v, []).append((e.u, e.length_m))
    best, heap = {}, [(0.0, anchor)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for u, c in into.get(n, ()):
            heapq.heappush(heap, (d + c, u))
    return best


def test_skim_and_paths_over_the_whole_grid(spark):
    rows = table(spark, SF, "edges").collect()
    by = {e.edge_idx: e for e in rows}
    anchors = {r.node_id for r in table(spark, SF, "schools").collect()}
    got = {(r.anchor, r.node_id): r.dist for r in Q.shortest_path_skim(spark, SF).collect()}
    want = {(a, n): d for a in anchors for n, d in dijkstra(rows, a).items()}
    assert got == pytest.approx(want) and len(got) >= 200
    paths = Q.path_extraction(spark, SF).collect()
    assert {p.start for p in paths} == {r.home_node for r in table(spark, SF, "households").collect()}
    for p in paths:
        at, total = p.start, 0.0
        for e in map(int, filter(None, p.path.split(","))):
            assert by[e].u == at
            at, total = by[e].v, total + by[e].length_m
        assert at == p.anchor and total == pytest.approx(min(want[a, p.start] for a in anchors))


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_block_distances(spark, block):
    edges = spark.createDataFrame([(i, (i * 5 + 1) % 40, i, float(1 + i % 3)) for i in range(40)] + [((i * 3 + 2) % 40, i, 40 + i, float(2 + i % 5)) for i in range(0, 40, 2)], "u long, v long, edge_idx long, length_m double")
    anchors = spark.createDataFrame([(3,), (17,), (6,), (16,)], "node_id long")
    blocks = spark.range(40).select(F.col("id").alias("node_id"), F.floor(F.col("id") / block).alias("block"))
    got = {(r.anchor, r.node_id): r.dist for r in K.block_distances(edges, anchors, "length_m", blocks).collect()}
    rows = edges.collect()
    want = {(a, n): dijkstra(rows, a).get(n, float("inf")) for a in (3, 17, 6, 16) for n in range(40)}
    assert got == pytest.approx(want) and sum(d < float("inf") for d in want.values()) > 40


def test_largest_component_of_the_whole_grid(spark):
    rows = table(spark, SF, "edges").where("edge_idx % 5 <> 0 and (u * 7 + v * 7) % 11 > 2").select("u", "v").collect()
    out, into = {}, {}
    for u, v in rows:
        out.setdefault(u, set()).add(v)
        into.setdefault(v, set()).add(u)

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            for n in step.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    left, parts = {n for r in rows for n in r}, []
    while left:
        n = min(left)
        parts.append(reach(n, out) & reach(n, into))
        left -= parts[-1]
    largest = max(parts, key=lambda p: (len(p), -min(p)))
    assert {r.node_id for r in Q.largest_component(spark, SF).collect()} == largest and len(largest) > 10
    got = {}
    for r in N.strong_components_two_way(spark.createDataFrame(rows)).collect():
        got.setdefault(r.component, set()).add(r.node_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts))


def test_places_are_merged_in_order(spark):
    ring = lambda x, z: [(x, z), (x + 50, z), (x + 50, z + 50), (x, z + 50), (x, z)]
    polygons = [(1, "Oak School", ring(0.0, 0.0)), (2, None, ring(1000.0, 0.0)), (3, "Elm", ring(5000.0, 5000.0))]
    places = [(i, f"Place {i % 7}" if i % 13 else "Swim club", (i * 37 % 100) / 100, float(i * 83 % 1500), float(i * 59 % 400)) for i in range(120)] + [(200, None, 0.9, 0.0, 300.0), (201, "Elm", 0.99, 5100.0, 5250.0)]
    schema = "id long, name string, ring array<struct<x: double, z: double>>"
    got = sorted(tuple(r) for r in O.merge_places(spark.createDataFrame(polygons, schema), spark.createDataFrame(places, "id long, name string, confidence double, x2 double, z2 double")).collect())

    def gap(p, f):
        if f[0] == "polygon":
            (x, z) = f[3]
            return math.hypot(max(x - p[3], 0, p[3] - x - 50), max(z - p[4], 0, p[4] - z - 50))
        return math.hypot(f[3][0] - p[3], f[3][1] - p[4])

    kept = [["polygon", i, n, r[0]] for i, n, r in polygons]
    for p in sorted(places, key=lambda p: (-p[2], p[0])):
        if p[2] < 0.75 or not p[1] or any(w in p[1].lower() for w in O.NO_SCHOOL_WORDS):
            continue
        near = min(kept, key=lambda f: (round(gap(p, f), 6), f[0] == "place", f[1]))
        if gap(p, near) <= 100:
            near[2] = near[2] or p[1]
        elif not any(f[2] == p[1] and gap(p, f) <= 300 and (f[0] == "place" or dict((a, b) for a, b, _ in polygons)[f[1]]) for f in kept):
            kept.append(["place", p[0], p[1], (p[3], p[4])])
    assert got == sorted((f[1], f[0], f[2]) for f in kept)
    assert any(k == "place" for _, k, _ in got) and len(got) < 40


def test_exits_take_the_next_free_node(spark):
    rows = [(1, 10, 1.0), (1, 11, 2.0), (2, 10, 0.5), (2, 11, 3.0), (2, 12, 4.0), (3, 10, 0.1), (4, 12, 0.1), (4, 13, 9.0)]
    got = {r.exit_id: r.node_id for r in P.snap_unique(spark.createDataFrame(rows, "exit_id long, node_id long, d double")).collect()}
    assert got == {1: 10, 2: 11, 4: 12}


def test_tour_goes_to_the_farthest_then_the_nearest(spark):
    stops = [(i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(12)]
    df = spark.createDataFrame([(1, 0.0, 0.0, stops)], "route long, x double, z double, stops array<struct<id: long, x: double, z: double>>")
    left = list(stops)
    tour = [max(left, key=lambda s: (math.hypot(s[1], s[2]), -s[0]))]
    left.remove(tour[0])
    while left:
        near = min(left, key=lambda s: (math.hypot(s[1] - tour[-1][1], s[2] - tour[-1][2]), s[0]))
        tour.append(near)
        left.remove(near)
    assert list(L.greedy_tour(df).first().tour) == [s[0] for s in tour]


#: Published points of the scene and where they lie.
POINTS = [(33.0165, -117.1225, 0.0, 0.0), (33.01402, -117.12246, 3.4158, 274.9383), (32.993, -117.165, -3973.5256, 2599.7922), (33.04, -117.08, 3971.419, -2601.403), (33.01867, -117.12186, 60.0539, -240.4979), (33.0, -117.09, 3033.8863, 1832.262), (33.03, -117.15, -2566.3248, -1499.947)]


def test_scene_points_to_the_centimetre(spark):
    x, z = R.scene(F.col("lon"), F.col("lat"), -117.1225, 33.0165)
    for r in spark.createDataFrame(POINTS, "lat double, lon double, x double, z double").select("x", "z", x.alias("got_x"), z.alias("got_z")).collect():
        assert abs(r.x - r.got_x) < 0.01 and abs(r.z - r.got_z) < 0.01


@pytest.mark.parametrize(("a", "b"), [("Design39 Campus", "Design39Campus"), ("The Óak Schools", "oak"), ("Oak Campus School", "OAK")])
def test_name_keys(spark, a, b):
    assert one(spark, S.name_key(F.lit(a))) == one(spark, S.name_key(F.lit(b)))


@pytest.mark.parametrize(("label", "want"), [("Camino del Sur south (to SR 56 west)", "Camino del Sur"), ("Northbound", ""), ("I-15 North", "I-15"), ("Southern Cross", "Southern Cross")])
def test_exit_roads(spark, label, want):
    assert one(spark, T.exit_road(F.lit(label))) == want


@pytest.mark.parametrize(("text", "want"), [("  Takes 1,200 cars ", "Takes 1,200 cars"), ("at 07:30", "at 07:30"), ("at 9:10", None), ("34 Oak Lane", None), ("12.05 or 12", "12.05 or 12"), ("13", None), ("", None)])
def test_safe_text(spark, text, want):
    assert one(spark, S.safe_text(F.lit(text), F.array(F.lit(1200.0), F.lit(12.0)), F.array(F.lit("7:30")))) == want


def test_speakers_of_three_schools(spark):
    """The least extreme whose school others speak for makes room for the most extreme of another school."""
    rows = [(i, float(i), "a" if i not in (6, 7, 13) else {6: "b", 7: "c", 13: "d"}[i]) for i in range(20)]
    out = L.polar(spark.createDataFrame(rows, "id long, approval double, school string"), "id", "approval", 3, "school").collect()
    assert sorted((r.side, r.id) for r in out) == [("high", 17), ("high", 18), ("high", 19), ("low", 0), ("low", 6), ("low", 7)]
    few = L.polar(spark.createDataFrame(rows[:5], "id long, approval double, school string"), "id", "approval", 3, "school").collect()
    assert sorted(r.id for r in few) == [0, 1, 3, 4]


def test_population_follows_its_groups(spark):
    """Every slot is lived in; sizes, vehicles and places come from the group's own shares; ages rule jobs, grades and licences."""
    sizes = lambda *p: [(n, s) for n, s in p]
    dists = spark.createDataFrame([("a", sizes((1, 1.0)), sizes((0, 1.0)), 0.0, 0.0, [(7, 1.0)]), ("b", sizes((2, 0.5), (4, 0.5)), sizes((1, 0.3), (2, 0.7)), 1.0, 0.5, [(8, 0.0), (9, 2.0)])], "block_group string, sizes array<struct<size: int, share: double>>, vehicles array<struct<n: int, share: double>>, worker_share double, wfh_share double, work array<struct<place: bigint, share: double>>")
    buildings = spark.createDataFrame([(i, "ab"[i % 2], i % 4) for i in range(400)], "building_id long, block_group string, capacity int")
    rows = P.synthesize(buildings, dists, 5).collect()
    slots = {(r.building_id, r.slot) for r in rows}
    assert len(slots) == sum(i % 4 for i in range(400))
    assert sorted(rows, key=str) == sorted(P.synthesize(buildings.repartition(7), dists, 5).collect(), key=str)
    a, b = ([r for r in rows if r.block_group == g] for g in "ab")
    assert {(r.size, r.n_vehicles, r.is_worker, r.work_place) for r in a} == {(1, 0, False, None)}
    assert {r.size for r in b} == {2, 4} and {r.n_vehicles for r in b} == {1, 2}
    assert all(r.is_worker == (19 <= r.age <= 64) for r in b) and {r.work_place for r in b if r.is_worker and not r.works_from_home} == {9}
    assert all((r.grade >= 0) == (5 <= r.age <= 17) and (r.age >= 16 or not r.has_license) for r in rows)
    two = [r for r in b if r.n_vehicles == 2]
    assert 0.6 < len(two) / len(b) < 0.8


def test_pupils_go_to_the_nearest_school_of_their_grade(spark):
    people = spark.createDataFrame([(1, 3, 1), (1, 3, 2), (1, 7, 3), (2, 3, 1), (2, -1, 2), (3, 5, 1), (1, 12, 4)], "building_id long, grade int, member int")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "building_id long, x double, z double")
    schools = spark.createDataFrame([(10, 0, 5, 100.0, 0.0), (9, 0, 5, -100.0, 0.0), (11, 6, 8, 20_000.0, 0.0), (12, 0, 8, 6000.0, 0.0)], "school_id long, g0 int, g1 int, x2 double, z2 double")
    got = {(r.building_id, r.grade, r.member): r.school_id for r in P.with_schools(people, places, schools).collect()}
    assert got == {(1, 3, 1): 9, (1, 3, 2): 9, (1, 7, 3): 12, (2, 3, 1): 12, (2, -1, 2): None, (3, 5, 1): None, (1, 12, 4): None}
    assert P.with_schools(people.limit(0), places, schools).count() == 0


def test_a_long_tour_takes_a_look_at_each_stop_a_step(spark):
    """1,500 stops on a grid full of ties: by id, and in seconds."""
    began = time.time()
    stops = [(i, float(i * 7919 % 1500 % 50 * 250), float(i * 7919 % 1500 // 50 * 250)) for i in range(1500)]
    df = spark.createDataFrame([(1, 0.0, 0.0, stops)], "route long, x double, z double, stops array<struct<id: long, x: double, z: double>>")
    got = L.greedy_tour(df, 1.3).first()
    left = {s[0]: s[1:] for s in stops}
    at = max(left, key=lambda i: (round(math.hypot(*left[i]), 6), -i))
    tour, km, place = [at], 0.0, left.pop(at)
    while left:
        at = min(left, key=lambda i: (round(math.dist(left[i], place), 6), i))
        km += math.dist(left[at], place)
        place = left.pop(at)
        tour.append(at)
    assert got.tour == tour and got.ride_km[0] == pytest.approx((km + math.hypot(*place)) * 1.3 / 1000)
    assert len(got.ride_km) == 1500 and time.time() - began < 60
