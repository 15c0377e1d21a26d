"""Spatial joins on grid cells.

Every join emits one side into the cells it can reach and meets the other by
equality of cells, so Spark can shuffle and split it; the exact predicate
follows. Scene axes: x points east, z south.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def cells_between(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(cell(lo, size), cell(hi, size)))


def spread(df: DataFrame) -> DataFrame:
    """A side that stands in many cells. Spark estimates its size from before the rows were multiplied, so it would broadcast what the driver can't hold; this has both sides shuffled."""
    return df.hint("merge")


def in_ring(x: Column, z: Column, ring: Column) -> Column:
    """Ray casting against a ring, an array of struct(x, z) whose last point repeats the first."""
    crossed = F.aggregate(
        F.sequence(F.lit(1), F.size(ring) - 1),
        F.lit(False),
        lambda inside, i: inside
        != F.coalesce(
            ((F.element_at(ring, i)["z"] > z) != (F.element_at(ring, i + 1)["z"] > z))
            & (x < F.element_at(ring, i)["x"] + (z - F.element_at(ring, i)["z"]) * (F.element_at(ring, i + 1)["x"] - F.element_at(ring, i)["x"]) / F.nullif(F.element_at(ring, i + 1)["z"] - F.element_at(ring, i)["z"], F.lit(0.0))),
            F.lit(False),
        ),
    )
    return crossed


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula."""
    twice = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda a, i: a + F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["z"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["z"])
    return F.abs(twice) / 2


def box_ring(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    at = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    return F.array(at(x0, z0), at(x1, z0), at(x1, z1), at(x0, z1), at(x0, z0))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Pairs of point and polygon. points: x, z, ...; polygons: ring, ... (no clashing names)."""
    ring = polygons.withColumn("area", ring_area(F.col("ring")))
    for axis in ("x", "z"):
        values = F.transform("ring", lambda p: p[axis])
        ring = ring.withColumn(f"cell_{axis}", cells_between(F.array_min(values), F.array_max(values), size))
    placed = points.withColumn("cell_x", cell(F.col("x"), size)).withColumn("cell_z", cell(F.col("z"), size))
    return placed.join(spread(ring), ["cell_x", "cell_z"]).where(in_ring(F.col("x"), F.col("z"), F.col("ring"))).drop("cell_x", "cell_z")


def smallest_polygon(points: DataFrame, polygons: DataFrame, key: str, value: str, polygon_key: str, size: float) -> DataFrame:
    """Value of the smallest polygon that contains each point, by id on ties; null if none does."""
    met = points_in_polygons(points, polygons, size).groupBy(key).agg(F.min_by(value, F.struct("area", polygon_key)).alias(value))
    return points.select(key).join(met, key, "left")


def first_polygon(points: DataFrame, polygons: DataFrame, key: str, polygon_key: str, size: float) -> DataFrame:
    """Least id of the polygons that contain each point; null if none does."""
    met = points_in_polygons(points, polygons, size).groupBy(key).agg(F.min(polygon_key).alias(polygon_key))
    return points.select(key).join(met, key, "left")


def within(left: DataFrame, right: DataFrame, distance: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows no further apart than distance, equal in the columns `on`. left: x, z, ...; right: x2, z2, ...; adds d."""
    a = left.withColumn("cell_x", cell(F.col("x"), distance)).withColumn("cell_z", cell(F.col("z"), distance))
    b = right.withColumn("cell_x", cells_between(F.col("x2") - distance, F.col("x2") + distance, distance))
    b = b.withColumn("cell_z", cells_between(F.col("z2") - distance, F.col("z2") + distance, distance))
    met = a.join(spread(b), ["cell_x", "cell_z", *(on or [])]).withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("z") - F.col("z2")))
    return met.where(F.col("d") <= distance).drop("cell_x", "cell_z")


def _far(points: DataFrame, targets: DataFrame, key: str, target_key: str, order: Column, span: tuple[float, float], least: float, on: list[str]) -> DataFrame:
    """Nearest target of each point at any distance: key, target_key, d.

    Both sides lie in cells, some 16 targets in each and at most 20,000 over
    all. A cell of targets is of no use to a cell of points if its box begins
    beyond where another's ends; points meet the targets of what is left.
    """
    from gridmill.operators.network import kept

    k = min(max(targets.count() // 16, 1), 20_000)
    size = max((span[0] * span[1] / k) ** 0.5, max(span) / k, least)
    box = lambda x, z: [f(c).alias(f"{n}_{c[0]}") for c in (x, z) for n, f in (("lo", F.min), ("hi", F.max))]
    placed = points.withColumn("cell_x", cell(F.col("x"), size)).withColumn("cell_z", cell(F.col("z"), size))
    held = targets.withColumn("to_x", cell(F.col("x2"), size)).withColumn("to_z", cell(F.col("z2"), size))
    p = kept(placed.groupBy(*on, "cell_x", "cell_z").agg(*box("x", "z")))
    t = kept(held.groupBy(*on, "to_x", "to_z").agg(*box("x2", "z2")).withColumnsRenamed({f"{n}_{c}": f"to_{n}_{c}" for n in ("lo", "hi") for c in "xz"}))
    gap = [F.greatest(F.col(f"to_lo_{c}") - F.col(f"hi_{c}"), F.col(f"lo_{c}") - F.col(f"to_hi_{c}"), F.lit(0.0)) for c in "xz"]
    most = [F.greatest(F.col(f"to_hi_{c}") - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"to_lo_{c}")) for c in "xz"]
    pairs = (p.join(t, on) if on else p.crossJoin(t)).select(*on, "cell_x", "cell_z", "to_x", "to_z", F.hypot(*gap).alias("begins"), F.hypot(*most).alias("ends"))
    bound = pairs.groupBy(*on, "cell_x", "cell_z").agg(F.min("ends").alias("bound"))
    ways = kept(pairs.join(bound, [*on, "cell_x", "cell_z"]).where("begins <= bound + 1e-3").select(*on, "cell_x", "cell_z", "to_x", "to_z"))
    sent = spread(placed.join(ways, [*on, "cell_x", "cell_z"]).drop("cell_x", "cell_z"))
    met = sent.join(held, [*on, "to_x", "to_z"]).withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("z") - F.col("z2"))).where(~F.isnan("d"))
    return met.groupBy(key).agg(F.min_by(target_key, order).alias(target_key), F.min("d").alias("d"))


def nearest(points: DataFrame, targets: DataFrame, key: str, target_key: str, reach: float, growth: float = 4.0, on: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Nearest target of each point (equal in the columns `on`), by id on ties. targets: target_key, x2, z2.

    Looks within `reach`, then, for the points without a hit alone, within one
    `growth` times as large, each search a cell join. Points that have none
    there either are far from all targets and are left to :func:`_far`.
    digits: distances that round alike are ties.
    """
    from gridmill.operators.network import kept

    bounds = targets.agg(F.min("x2"), F.max("x2"), F.min("z2"), F.max("z2")).first()
    extent = points.agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    if bounds[0] is None or extent[0] is None:
        return points.select(key).withColumn(target_key, F.lit(None).cast(targets.schema[target_key].dataType)).withColumn("d", F.lit(None).cast("double"))
    span = max(bounds[1], extent[1]) - min(bounds[0], extent[0]), max(bounds[3], extent[3]) - min(bounds[2], extent[2])
    found, rest = None, points.select(key, "x", "z", *(on or []))
    order = F.struct(F.col("d") if digits is None else F.round("d", digits), F.col(target_key))
    for r in (reach, reach * growth):
        hit = kept(within(rest, targets, r, on).groupBy(key).agg(F.min_by(target_key, order).alias(target_key), F.min("d").alias("d")))
        found = hit if found is None else found.union(hit)
        rest = kept(rest.join(hit.select(key), key, "left_anti"))
        if rest.isEmpty():
            return points.select(key).join(found, key, "left")
    far = _far(rest, targets, key, target_key, order, span, reach, on or [])
    return points.select(key).join(found.union(far), key, "left")


def segment_distance(px: Column, pz: Column, x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    """Distance of a point to a segment, by clamped projection."""
    dx, dz = x1 - x0, z1 - z0
    t = F.coalesce(((px - x0) * dx + (pz - z0) * dz) / F.nullif(dx * dx + dz * dz, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x0 + t * dx), pz - (z0 + t * dz))


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, reach: float, tie: float = 0.5) -> DataFrame:
    """Nearest directed edge within reach; among those within `tie` of the least distance, the one whose end is closest.

    segments: edge_idx, x0, z0, x1, z1. Points without one get null.
    """
    placed = points.withColumn("cell_x", cell(F.col("x"), reach)).withColumn("cell_z", cell(F.col("z"), reach))
    s = segments.withColumn("cell_x", cells_between(F.least("x0", "x1") - reach, F.greatest("x0", "x1") + reach, reach))
    s = s.withColumn("cell_z", cells_between(F.least("z0", "z1") - reach, F.greatest("z0", "z1") + reach, reach))
    d = segment_distance(*(F.col(c) for c in ("x", "z", "x0", "z0", "x1", "z1")))
    met = placed.join(spread(s), ["cell_x", "cell_z"]).withColumn("d", d).where(F.col("d") <= reach)
    met = met.withColumn("end", F.hypot(F.col("x") - F.col("x1"), F.col("z") - F.col("z1")))
    # the window's shuffle serves the aggregation too
    close = met.withColumn("least", F.min("d").over(W.partitionBy(key))).where(F.col("d") <= F.col("least") + tie)
    best = close.groupBy(key).agg(F.min_by("edge_idx", F.struct(F.round("end", 6), F.col("edge_idx"))).alias("edge_idx"), F.min("least").alias("d"))
    return points.select(key).join(best, key, "left")


def within_segments(points: DataFrame, segments: DataFrame, most: float) -> DataFrame:
    """Pairs of point and segment no further apart than the segment's reach, which is at most `most`. points: x, z, ...; segments: x0, z0, x1, z1, reach, ...; adds d."""
    placed = points.withColumn("cell_x", cell(F.col("x"), most)).withColumn("cell_z", cell(F.col("z"), most))
    s = segments.withColumn("cell_x", cells_between(F.least("x0", "x1") - F.col("reach"), F.greatest("x0", "x1") + F.col("reach"), most))
    s = s.withColumn("cell_z", cells_between(F.least("z0", "z1") - F.col("reach"), F.greatest("z0", "z1") + F.col("reach"), most))
    d = segment_distance(*(F.col(c) for c in ("x", "z", "x0", "z0", "x1", "z1")))
    return placed.join(spread(s), ["cell_x", "cell_z"]).withColumn("d", d).where("d <= reach").drop("cell_x", "cell_z")


def clear_of(points: DataFrame, boxes: DataFrame, roads: DataFrame, buffer: float, most: float, key: str) -> DataFrame:
    """Points further than buffer from every building and than half a width and buffer from every road.

    boxes: x0, z0, x1, z1; roads: x0, z0, x1, z1, half_m; most: the largest half width plus buffer.
    """
    b = boxes.select("x0", "z0", "x1", "z1").withColumn("cell_x", cells_between(F.col("x0") - buffer, F.col("x1") + buffer, most)).withColumn("cell_z", cells_between(F.col("z0") - buffer, F.col("z1") + buffer, most))
    placed = points.withColumn("cell_x", cell(F.col("x"), most)).withColumn("cell_z", cell(F.col("z"), most))
    gap = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    near_box = placed.join(spread(b), ["cell_x", "cell_z"]).where(F.hypot(gap("x", "x0", "x1"), gap("z", "z0", "z1")) <= buffer).select(key)
    near_road = within_segments(points, roads.select("x0", "z0", "x1", "z1", (F.col("half_m") + buffer).alias("reach")), most).select(key)
    return points.join(near_box, key, "left_anti").join(near_road, key, "left_anti")


def stop_access(homes: DataFrame, stops: DataFrame, key: str, most_km: float, circuity: float, current: str) -> DataFrame:
    """Walk to the nearest stop of a route, straight line times circuity; it replaces the current route's only if within most_km and shorter. homes: key, x, z, current; stops: x2, z2."""
    near = within(homes.select(key, "x", "z"), stops.select("x2", "z2"), most_km * 1000 / circuity).groupBy(key).agg((F.min("d") * circuity / 1000).alias("walk_km"))
    joined = homes.join(near, key, "left")
    better = F.col("walk_km").isNotNull() & (F.col(current).isNull() | (F.col("walk_km") < F.col(current)))
    return joined.select(key, F.when(better, F.col("walk_km")).otherwise(F.col(current)).alias("walk_km"), better.alias("replaced"))


def neighbour_share(points: DataFrame, key: str, distance: float, marked: Column, least: int, share: float) -> DataFrame:
    """Neighbours within distance, how many are marked, and whether both their number and share suffice."""
    others = points.select(F.col(key).alias("other"), F.col("x").alias("x2"), F.col("z").alias("z2"), marked.alias("marked"))
    met = within(points.select(key, "x", "z"), others, distance).where(F.col(key) != F.col("other"))
    counts = met.groupBy(key).agg(F.count("*").alias("neighbours"), F.count_if("marked").alias("n_marked"))
    out = points.select(key).join(counts, key, "left").na.fill(0, ["neighbours", "n_marked"])
    return out.withColumn("flag", (F.col("n_marked") >= least) & (F.col("n_marked") >= F.lit(share) * F.col("neighbours")))


def banded_nearest(persons: DataFrame, schools: DataFrame, reach: float = 1000.0) -> DataFrame:
    """Nearest school that serves each person's grade, by id on ties; null if none does.

    persons: person_id, grade, x, z; schools: school_id, g0, g1, x2, z2. Grades
    are few, so the schools are spread over the grades they serve, and person
    and school meet by grade and cell.
    """
    served = schools.withColumn("grade", F.explode(F.sequence("g0", "g1"))).drop("g0", "g1")
    able = persons.join(served.select("grade").distinct(), "grade", "left_semi")
    best = nearest(able, served, "person_id", "school_id", reach, on=["grade"], digits=6)
    return persons.select("person_id").join(best.select("person_id", "school_id"), "person_id", "left")


def bearing(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    """Compass bearing in degrees; north is -z."""
    return F.pmod(F.degrees(F.atan2(x1 - x0, z0 - z1)), F.lit(360.0))


def circular_gap(a: Column, b: Column) -> Column:
    gap = F.pmod(a - b, F.lit(360.0))
    return F.least(gap, F.lit(360.0) - gap)


def match_one_to_one(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Each left row's nearest right row within tolerance; a right row goes to its closest claimant only. left: id, x, z; right: id2, x2, z2."""
    best = within(left, right, tolerance).withColumn("d", F.round("d", 6)).groupBy("id").agg(F.min(F.struct("d", "id2")).alias("m")).select("id", "m.id2", "m.d")
    claim = F.row_number().over(W.partitionBy("id2").orderBy("d", "id"))
    return best.withColumn("claim", claim).where("claim = 1").drop("claim")


def arc_length(points: DataFrame, by: str, order: str) -> DataFrame:
    """Cumulative length along each polyline."""
    along = W.partitionBy(by).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(along), F.col("z") - F.lag("z").over(along))
    return points.withColumn("step_m", F.coalesce(step, F.lit(0.0))).withColumn("along_m", F.sum("step_m").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))


def direction_shares(directions: DataFrame, exits: DataFrame, sigma_deg: float) -> DataFrame:
    """exit_id, share: each direction's share split over the exits by a Gaussian kernel on the angle between them; where all exits are too far for that, evenly over the nearest.

    directions: bearing, share, a table of parameters that every exit meets;
    exits: exit_id, exit_bearing. Shares sum to those of the directions.
    """
    met = exits.join(F.broadcast(directions.select("bearing", "share").withColumn("direction", F.monotonically_increasing_id())))
    met = met.withColumn("gap", circular_gap(F.col("bearing"), F.col("exit_bearing"))).withColumn("w", F.exp(-0.5 * F.pow(F.col("gap") / sigma_deg, F.lit(2.0))))
    sums = met.groupBy("direction").agg(F.sum("w").alias("total"), F.min("gap").alias("least"), F.count("*").alias("n"))
    ties = met.join(F.broadcast(sums), "direction")
    w = F.when(F.col("total") >= 1e-6, F.col("w")).otherwise((F.col("gap") == F.col("least")).cast("double"))
    even = ties.withColumn("w", w)
    whole = even.groupBy("direction").agg(F.sum("w").alias("whole"))
    return even.join(F.broadcast(whole), "direction").groupBy("exit_id").agg(F.sum(F.col("share") * F.col("w") / F.col("whole")).alias("share"))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted centroid (x, z) of a closed ring; null for rings without area."""
    at = lambda k: F.get(ring, k)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))

    def add(s, k):
        p, q, o = at(k), at(k + 1), at(F.lit(0))  # from the first corner, so that far places lose no digits
        px, pz, qx, qz = p["x"] - o["x"], p["z"] - o["z"], q["x"] - o["x"], q["z"] - o["z"]
        cross = px * qz - qx * pz
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (px + qx) * cross).alias("x"), (s["z"] + (pz + qz) * cross).alias("z"))

    s = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), start, add)
    area = F.when(s["a"] != 0, s["a"] * 3)
    return at(F.lit(0))["x"] + s["x"] / area, at(F.lit(0))["z"] + s["z"] / area


def zonal_cells(polygons: DataFrame, cells: DataFrame, key: str, x0: float, z1: float, size: float) -> DataFrame:
    """What a raster holds inside each polygon: key, covered, cover, points, density, median, p90, eave (p5), ridge (p99).

    polygons: key, ring array<struct<x, z>>; cells: row, col, v, n (its points);
    row 0 is at z1 and x0, empty cells have no row. covered counts the cells
    whose centre lies inside, cover is the share of these with a value, density
    the points a square metre of them. A polygon that covers no centre takes the
    value of the cell under its centroid, with covered 0; null where that is empty.
    """
    span = lambda lo, hi: F.when(F.ceil(lo) <= F.floor(hi), F.sequence(F.ceil(lo), F.floor(hi)))
    xs, zs = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["z"])
    rows = polygons.withColumn("row", F.explode(span((z1 - F.array_max(zs)) / size - 0.5, (z1 - F.array_min(zs)) / size - 0.5)))
    inside = rows.withColumn("col", F.explode(span((F.array_min(xs) - x0) / size - 0.5, (F.array_max(xs) - x0) / size - 0.5)))
    inside = inside.where(in_ring(x0 + (F.col("col") + 0.5) * size, z1 - (F.col("row") + 0.5) * size, F.col("ring"))).select(key, "row", "col")
    held = inside.join(cells.select("row", "col", "v", "n"), ["row", "col"], "left")
    q = F.percentile("v", F.array(*[F.lit(s) for s in (0.5, 0.9, 0.05, 0.99)]))
    sums = held.groupBy(key).agg(F.count("*").alias("covered"), F.avg(F.col("v").isNotNull().cast("int")).alias("cover"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"), q.alias("q"))
    sums = sums.withColumn("density", F.col("points") / (F.col("covered") * size * size))
    names = ("median", "p90", "eave", "ridge")
    full = sums.select(key, "covered", "cover", "points", "density", *[F.get("q", i).alias(c) for i, c in enumerate(names)])
    cx, cz = ring_centroid(F.col("ring"))
    bare = polygons.join(sums.select(key), key, "left_anti").select(key, F.floor((z1 - cz) / size).alias("row"), F.floor((cx - x0) / size).alias("col"))
    under = bare.join(cells.select("row", "col", "v"), ["row", "col"], "left")
    none = F.lit(None).cast("double")
    return full.union(under.select(key, F.lit(0), none, F.lit(0), none, *["v"] * 4))
