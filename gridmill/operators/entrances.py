"""Where campuses are entered, where exits leave the network, and where workers leave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.operators.spatial import cells_between, in_ring, nearest, segment_distance, spread
from gridmill.operators.world import near_rings


def _foot(px: Column, pz: Column, x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    """struct(x, z): the point of a segment that is nearest to a point."""
    dx, dz = x1 - x0, z1 - z0
    t = F.coalesce(((px - x0) * dx + (pz - z0) * dz) / F.nullif(dx * dx + dz * dz, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.struct((x0 + t * dx).alias("x"), (z0 + t * dz).alias("z"))


def _sides(ring: Column, of) -> Column:
    """Array of of(start, end, number) over the sides of a closed ring."""
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: of(F.element_at(ring, i), F.element_at(ring, i + 1), i))


def segment_ring_distance(x0: Column, z0: Column, x1: Column, z1: Column, ring: Column) -> Column:
    """Distance of a segment to a polygon; 0 where it touches, crosses or lies inside."""
    turn = lambda ax, az, bx, bz, cx, cz: (bx - ax) * (cz - az) - (bz - az) * (cx - ax)

    def side(a: Column, b: Column, _: Column) -> Column:
        apart = (turn(x0, z0, x1, z1, a["x"], a["z"]) * turn(x0, z0, x1, z1, b["x"], b["z"]) < 0) & (turn(a["x"], a["z"], b["x"], b["z"], x0, z0) * turn(a["x"], a["z"], b["x"], b["z"], x1, z1) < 0)
        to_side = [segment_distance(x, z, a["x"], a["z"], b["x"], b["z"]) for x, z in ((x0, z0), (x1, z1))]
        to_segment = [segment_distance(p["x"], p["z"], x0, z0, x1, z1) for p in (a, b)]
        return F.when(apart, 0.0).otherwise(F.least(*to_side, *to_segment))

    return F.when(in_ring(x0, z0, ring), 0.0).otherwise(F.array_min(_sides(ring, side)))


def boundary_point(px: Column, pz: Column, ring: Column) -> Column:
    """struct(x, z): the point of a ring's line nearest to a point, on the first such side."""

    def side(a: Column, b: Column, i: Column) -> Column:
        p = _foot(px, pz, a["x"], a["z"], b["x"], b["z"])
        return F.struct(F.round(F.hypot(p["x"] - px, p["z"] - pz), 6).alias("d"), i.alias("i"), p.alias("p"))

    return F.array_min(_sides(ring, side))["p"]


def campus_entrances(campuses: DataFrame, nodes: DataFrame, edges: DataFrame, ranks: dict[str, int], freeways: list[str], search: float = 150.0, near: float = 60.0) -> DataFrame:
    """campus, node_id, approach_edge, x, z, snap_m, main_road: where traffic enters each campus.

    The main road is the one of highest rank (classes not in ranks have none)
    within `search`, the closest to the core on ties, then the first by name. The
    boundary point faces its point nearest to the core; without a main road,
    the core itself. The entrance is the node nearest to that boundary point
    (then the least id) among nodes that a non-freeway edge enters: those within
    `near` of the campus, and the main road's own within `search`. The approach is
    the longest non-freeway edge into it, the first on ties. A campus without a
    candidate has no row. campuses: campus, ring, core_x, core_z; nodes: node_id,
    x, z; edges: edge_idx, u, v, highway, road (null: no name), length_m.
    """
    from gridmill.operators.network import kept

    end = lambda n: nodes.select(F.col("node_id").alias({"0": "u", "1": "v"}[n]), F.col("x").alias(f"x{n}"), F.col("z").alias(f"z{n}"))
    rank = F.coalesce(*[F.when(F.col("highway") == k, F.lit(r)) for k, r in ranks.items()], F.lit(0))
    lines = edges.withColumn("rank", rank).where("rank > 0").join(end("0"), "u").join(end("1"), "v").select("edge_idx", "u", "v", F.coalesce("road", F.concat(F.lit("#"), F.col("edge_idx"))).alias("road"), "rank", "x0", "z0", "x1", "z1")
    size, around = search * 2, campuses
    for axis in ("x", "z"):
        values = F.transform("ring", lambda p: p[axis])
        around = around.withColumn(f"cell_{axis}", cells_between(F.array_min(values) - search, F.array_max(values) + search, size))
        lines = lines.withColumn(f"cell_{axis}", cells_between(F.least(f"{axis}0", f"{axis}1"), F.greatest(f"{axis}0", f"{axis}1"), size))
    seg = [F.col(c) for c in ("x0", "z0", "x1", "z1")]
    beside = lines.join(spread(around), ["cell_x", "cell_z"]).where(segment_ring_distance(*seg, F.col("ring")) <= search)
    beside = kept(beside.select("campus", "road", "rank", "edge_idx", "u", "v", F.round(segment_distance(F.col("core_x"), F.col("core_z"), *seg), 6).alias("d"), _foot(F.col("core_x"), F.col("core_z"), *seg).alias("p")).distinct())
    by_road = beside.groupBy("campus", "road").agg(F.max("rank").alias("rank"), F.min("d").alias("d"))
    main = by_road.groupBy("campus").agg(F.min_by("road", F.struct(-F.col("rank"), "d", "road")).alias("road"))
    own = kept(beside.join(main, ["campus", "road"]))
    facing = own.groupBy("campus").agg(F.min_by("p", F.struct("d", "edge_idx")).alias("p"), F.first("road").alias("main_road"))
    towards = campuses.join(facing, "campus", "left").withColumn("b", boundary_point(F.coalesce("p.x", "core_x"), F.coalesce("p.z", "core_z"), F.col("ring")))
    towards = kept(towards.select("campus", "ring", "b", "main_road"))

    enters = edges.where(~F.col("highway").isin(freeways)).groupBy(F.col("v").alias("node_id")).agg(F.max_by("edge_idx", F.struct("length_m", -F.col("edge_idx"))).alias("approach_edge"))
    places = nodes.join(enters, "node_id").select("node_id", "approach_edge", F.col("x").alias("x2"), F.col("z").alias("z2"))
    junctions = own.select("campus", F.explode(F.array("u", "v")).alias("node_id")).distinct().withColumn("of_main", F.lit(True))
    met = near_rings(places, towards, search).join(junctions, ["campus", "node_id"], "left").where((F.col("d") <= near) | F.col("of_main"))
    gap = F.hypot(F.col("x2") - F.col("b.x"), F.col("z2") - F.col("b.z"))
    best = met.groupBy("campus").agg(F.min_by(F.struct("node_id", "approach_edge", "b", gap.alias("snap_m"), "main_road"), F.struct(F.round(gap, 6), "node_id")).alias("e"))
    return best.select("campus", "e.node_id", "e.approach_edge", "e.b.x", "e.b.z", "e.snap_m", "e.main_road")


def via_exits(snapped: DataFrame, asked: DataFrame, reach: float = 1000.0) -> DataFrame:
    """exit_id, node_id, via: snapped exits with their own node (via null), and the others with that of the snapped exit nearest to their place, the least id on ties.

    snapped: exit_id, node_id; asked: exit_id, x, z for all exits. An exit without
    a place that was not snapped has no row; if none was snapped, there are none.
    """
    at = snapped.join(asked, "exit_id").select(F.col("exit_id").alias("via"), F.col("node_id"), F.col("x").alias("x2"), F.col("z").alias("z2"))
    lost = asked.where("x is not null and z is not null").join(snapped.select("exit_id"), "exit_id", "left_anti")
    ways = nearest(lost, at.where("x2 is not null and z2 is not null"), "exit_id", "via", reach, digits=6).select("exit_id", "via")
    led = ways.join(at.select("via", "node_id"), "via").select("exit_id", "node_id", "via")
    return snapped.select("exit_id", "node_id", F.lit(None).cast(led.schema["via"].dataType).alias("via")).union(led)


def repaired_work(persons: DataFrame, exits: DataFrame, nodes: DataFrame, reach: float = 500.0) -> DataFrame:
    """person_id, work_exit, work_node: workers outside work at their exit's node.

    An unknown exit becomes null, an unknown node too; a worker left without a
    node but with a place (finite work_x, work_z) works at the nearest. persons:
    person_id, is_worker, work_exit, work_node, work_x, work_z; exits: exit_id,
    node_id; nodes: node_id, x2, z2.
    """
    known = nodes.select(F.col("node_id").alias("work_node"), F.lit(True).alias("known"))
    gone = exits.select(F.col("exit_id").alias("work_exit"), F.col("node_id").alias("exit_node"))
    met = persons.join(gone, "work_exit", "left").join(known, "work_node", "left")
    met = met.withColumn("node", F.coalesce("exit_node", F.when(F.col("known"), F.col("work_node"))))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    lost = met.where(F.col("is_worker") & F.col("node").isNull() & finite("work_x") & finite("work_z"))
    near = nearest(lost.select("person_id", F.col("work_x").alias("x"), F.col("work_z").alias("z")), nodes, "person_id", "node_id", reach, digits=6).select("person_id", F.col("node_id").alias("near"))
    out = met.join(near, "person_id", "left")
    return out.select("person_id", F.when(F.col("exit_node").isNotNull(), F.col("work_exit")).alias("work_exit"), F.coalesce("node", "near").alias("work_node"))


def best_scene(scenes: DataFrame, pixels: DataFrame, most_cloud: float, bad: list[int], few: int = 8, tie: float = 1e-4) -> DataFrame:
    """scene, bad_share: of the `few` least cloudy scenes under the limit, the one with the least share of bad pixels here.

    Scenes are taken by cloud, then by name; one replaces the best so far if its
    share is lower by more than `tie`, or within it and its (date, version) is
    later. A scene without pixels counts as all bad. scenes: scene, cloud, date,
    version; pixels: scene, cls. No scene under the limit gives no row.
    """
    some = scenes.where(F.col("cloud") <= most_cloud).orderBy("cloud", "scene").limit(few)
    share = pixels.join(F.broadcast(some.select("scene")), "scene", "left_semi").groupBy("scene").agg(F.avg(F.col("cls").isin(bad).cast("double")).alias("bad_share"))
    row = F.struct("cloud", "scene", F.coalesce("bad_share", F.lit(1.0)).alias("bad_share"), "date", "version")
    tried = some.join(share, "scene", "left").agg(F.sort_array(F.collect_list(row)).alias("tried")).where(F.size("tried") > 0)
    gap = lambda a, x: x["bad_share"] - a["bad_share"]
    later = lambda a, x: F.struct(x["date"], x["version"]) > F.struct(a["date"], a["version"])
    step = lambda a, x: F.when((gap(a, x) < -tie) | ((F.abs(gap(a, x)) <= tie) & later(a, x)), x).otherwise(a)
    return tried.select(F.aggregate("tried", F.element_at("tried", 1), step).alias("s")).select("s.scene", "s.bad_share")
