"""Matching of campuses, places and buildings, and what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.scalars import name_key
from gridmill.operators.grid import best_shift
from gridmill.operators.network import kept
from gridmill.operators.spatial import cells_between, cell, circular_gap, points_in_polygons, segment_distance, within

#: Words in a name that make it a school's.
SCHOOL_WORDS = ["school", "academy", "elementary", "middle", "high", "montessori", "preschool", "campus", "college"]
#: Words in the names of places that are no schools though listed as such.
NO_SCHOOL_WORDS = ["district", "football", "band", "swim", "music", "kindermusik", "garden", "services", "group", "tutor", "parents", "sports", "dance", "driving", "math"]


def _bounded(rings: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Rings in every cell that their box, widened by margin, touches."""
    for axis in ("x", "z"):
        values = F.col("ring")[axis]
        rings = rings.withColumn(f"cell_{axis}", cells_between(F.array_min(values) - margin, F.array_max(values) + margin, size))
    return rings


def _ring_distance(x: Column, z: Column, ring: Column) -> Column:
    """Distance of a point to a ring's line."""
    at = lambda i: F.element_at(ring, i)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: segment_distance(x, z, at(i)["x"], at(i)["z"], at(i + 1)["x"], at(i + 1)["z"])))


def near_rings(points: DataFrame, rings: DataFrame, reach: float) -> DataFrame:
    """Pairs of point (x2, z2, ...) and ring no further apart than reach; d is 0 inside."""
    placed = points.withColumn("cell_x", cell(F.col("x2"), reach)).withColumn("cell_z", cell(F.col("z2"), reach))
    from gridmill.operators.spatial import in_ring, spread

    met = placed.join(spread(_bounded(rings, reach, reach)), ["cell_x", "cell_z"]).drop("cell_x", "cell_z")

    inside = in_ring(F.col("x2"), F.col("z2"), F.col("ring"))
    return met.withColumn("d", F.when(inside, 0.0).otherwise(_ring_distance(F.col("x2"), F.col("z2"), F.col("ring")))).where(F.col("d") <= reach)


def match_campuses(features: DataFrame, schools: DataFrame, reach: float) -> DataFrame:
    """feature_id and the school it is, or null.

    An equal name key wins (of several schools the last by id). Else a ring takes
    the first school inside it, or the nearest within reach (the last by id on
    ties), unless its own name is another school's. features: feature_id, name,
    ring (null for points); schools: school_id, name, x2, z2.
    """
    keyed = features.withColumn("key", name_key(F.coalesce("name", F.lit(""))))
    by_key = schools.select(name_key(F.col("name")).alias("key"), "school_id").groupBy("key").agg(F.max("school_id").alias("named")).where("key <> ''")
    free = features.where(F.col("ring").isNotNull() & ~F.coalesce(F.lower("name").rlike("|".join(SCHOOL_WORDS)), F.lit(False)))
    met = near_rings(schools.select("school_id", "x2", "z2"), free.select("feature_id", "ring"), reach)
    best = met.groupBy("feature_id").agg(F.min(F.when(F.col("d") == 0, F.col("school_id"))).alias("inside"), F.min_by("school_id", F.struct(F.round("d", 6), -F.col("school_id"))).alias("near"))
    out = keyed.join(by_key, "key", "left").join(best, "feature_id", "left")
    return out.select("feature_id", F.coalesce("named", "inside", "near").alias("school_id"))


def first_kept(ids: DataFrame, clashes: DataFrame) -> DataFrame:
    """The ids that a walk in order keeps: each unless one kept before clashes with it. ids: id; clashes: earlier, later.

    Rounds decide every id whose earlier rivals are decided, so their number is
    that of the longest chain of clashes, not of ids.
    """
    undecided, done, links = kept(ids.select("id")), None, kept(clashes.select("earlier", "later"))
    while not undecided.isEmpty():
        chosen = kept(undecided.join(links.select(F.col("later").alias("id")), "id", "left_anti"))
        done = chosen if done is None else kept(done.union(chosen))
        gone = kept(links.join(chosen.select(F.col("id").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("id")).distinct())
        undecided = kept(undecided.join(chosen, "id", "left_anti").join(gone, "id", "left_anti"))
        links = kept(links.join(undecided.select(F.col("id").alias("later")), "later", "left_semi").join(undecided.select(F.col("id").alias("earlier")), "earlier", "left_semi"))
    return done if done is not None else ids.select("id")


def merge_places(polygons: DataFrame, places: DataFrame, reach: float = 100.0, same_name: float = 300.0, least: float = 0.75) -> DataFrame:
    """School features: all polygons, then places that duplicate none of them: feature, kind, name.

    Places go by falling confidence (then id); those under `least`, without a
    name or with one that schools don't have are left out. A place within reach
    of a feature kept so far is a duplicate, and names it if that is the nearest
    and has no name; one of the same name within `same_name` is dropped.
    polygons: id, name, ring; places: id, name, confidence, x2, z2.
    """
    fit = places.where((F.col("confidence") >= least) & (F.col("name") != "") & ~F.lower("name").rlike("|".join(NO_SCHOOL_WORDS)))
    fit = fit.withColumn("order", F.struct(-F.col("confidence"), F.col("id")))
    to_rings = kept(near_rings(fit.select("id", "name", "order", "x2", "z2"), polygons.select(F.col("id").alias("ring_id"), F.col("name").alias("ring_name"), "ring"), max(reach, same_name)).drop("ring"))
    by_ring = to_rings.where((F.col("d") <= reach) | (F.col("ring_name") == F.col("name"))).select("id").distinct()
    rest = fit.join(by_ring, "id", "left_anti")
    a = fit.select("id", "name", "order", F.col("x2").alias("x"), F.col("z2").alias("z"))
    b = rest.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("order").alias("other_order"), "x2", "z2")
    pairs = kept(within(a, b, max(reach, same_name)).where(F.col("other_order") < F.col("order")).where((F.col("d") <= reach) | (F.col("name") == F.col("other_name"))))
    stay = first_kept(rest, pairs.join(rest.select("id"), "id", "left_semi").select(F.col("other").alias("earlier"), F.col("id").alias("later")))
    # the nearest feature of a duplicate: a polygon, or a place that stayed
    options = to_rings.where(F.col("d") <= reach).select("id", "name", "order", "d", F.struct(F.lit(0).alias("kind"), F.col("ring_id").alias("feature")).alias("f"))
    options = options.union(pairs.where(F.col("d") <= reach).join(stay.select(F.col("id").alias("other")), "other", "left_semi").select("id", "name", "order", "d", F.struct(F.lit(1).alias("kind"), F.col("other").alias("feature")).alias("f")))
    nearest = options.groupBy("id", "name", "order").agg(F.min_by("f", F.struct(F.round("d", 6), F.col("f"))).alias("f"))
    names = nearest.where("f.kind = 0").groupBy(F.col("f.feature").alias("id")).agg(F.min_by("name", "order").alias("given"))
    rings = polygons.join(names, "id", "left").select(F.col("id").alias("feature"), F.lit("polygon").alias("kind"), F.coalesce(F.nullif("name", F.lit("")), F.col("given")).alias("name"))
    return rings.union(rest.join(stay, "id", "left_semi").select("id", F.lit("place"), "name"))


def street_context(footprints: DataFrame, streets: DataFrame, reach: float, most: int = 3, least_gap: float = 25.0) -> DataFrame:
    """Streets around each footprint: up to `most`, nearest first, each over least_gap degrees from those before it.

    footprints: id, x, z (centre); streets: street_id, cls, x0, z0, x1, z1.
    Returns id, streets array<struct(d, cls, street_id, bearing)>.
    """
    placed = footprints.withColumn("cell_x", cell(F.col("x"), reach)).withColumn("cell_z", cell(F.col("z"), reach))
    s = streets.withColumn("cell_x", cells_between(F.least("x0", "x1") - reach, F.greatest("x0", "x1") + reach, reach))
    s = s.withColumn("cell_z", cells_between(F.least("z0", "z1") - reach, F.greatest("z0", "z1") + reach, reach))
    dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
    t = F.coalesce(((F.col("x") - F.col("x0")) * dx + (F.col("z") - F.col("z0")) * dz) / F.nullif(dx * dx + dz * dz, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    met = placed.join(s, ["cell_x", "cell_z"]).withColumn("t", t).withColumn("px", F.col("x0") + F.col("t") * dx).withColumn("pz", F.col("z0") + F.col("t") * dz)
    met = met.withColumn("d", F.round(F.hypot(F.col("x") - F.col("px"), F.col("z") - F.col("pz")), 2)).where(F.col("d") <= reach)
    bearing = F.round(F.pmod(F.degrees(F.atan2(F.col("px") - F.col("x"), F.col("z") - F.col("pz"))), F.lit(360.0)), 4)
    listed = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "cls", "street_id", bearing.alias("bearing")))).alias("all"))
    none = F.filter("all", lambda c: F.lit(False))
    far = lambda chosen, c: F.forall(chosen, lambda k: circular_gap(c["bearing"], k["bearing"]) > least_gap)
    chosen = F.aggregate("all", none, lambda a, c: F.when((F.size(a) < most) & far(a, c), F.concat(a, F.array(c))).otherwise(a))
    return footprints.select("id").join(listed.select("id", chosen.alias("streets")), "id", "left")


def missing_buildings(found: DataFrame, bridges: DataFrame, footprints: DataFrame, width: float, elongation: float, box: tuple[float, float, float, float], buffer: float = 10.0, touch: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): candidates worth adding with their quality, and how many go for which reason.

    found: id, x, z, w, len, roof_type, height, area, n_points; bridges,
    footprints: x2, z2. Reasons in order: no roof model, thin or long, on a
    bridge (within buffer), outside the box (x0, z0, x1, z1). Poor: few points,
    or low, small and flat like a trailer; fair: beside a footprint or not many
    points; else good.
    """
    near = lambda other, d, name: within(found.select("id", "x", "z"), other.select("x2", "z2"), d).select("id").distinct().withColumn(name, F.lit(True))
    rows = found.join(near(bridges, buffer, "on_bridge"), "id", "left").join(near(footprints, touch, "adjacent"), "id", "left")
    inside = F.col("x").between(box[0], box[2]) & F.col("z").between(box[1], box[3])
    thin = (F.col("w") < width) | (F.col("len") / F.greatest("w", F.lit(1e-6)) > elongation)
    reason = F.when(F.col("roof_type") == "unknown", "no_roof_model").when(thin, "thin_or_elongated").when(F.col("on_bridge"), "on_bridge").when(~inside, "outside_box")
    rows = rows.withColumn("reason", reason)
    trailer = (F.col("roof_type") == "flat") & (F.col("height") < 4.5) & (F.col("area") < 150)
    quality = F.when(trailer | (F.col("n_points") < 12), "poor").when(F.coalesce("adjacent", F.lit(False)) | (F.col("n_points") < 40), "fair").otherwise("good")
    return rows.where("reason is null").select("id", quality.alias("quality")), rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def registration(mask: DataFrame, footprints: DataFrame, size: int, samples: int, reach: int) -> DataFrame:
    """Median shift (dr, dc) over the sample boxes with the most footprint cells. mask, footprints: row, col; a box is size x size cells."""
    boxed = lambda df: df.select("row", "col", F.floor(F.col("row") / size).alias("br"), F.floor(F.col("col") / size).alias("bc"))
    dense = boxed(footprints).groupBy("br", "bc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "br", "bc").limit(samples)
    shifts = [best_shift(boxed(mask).where((F.col("br") == b.br) & (F.col("bc") == b.bc)), boxed(footprints).where((F.col("br") == b.br) & (F.col("bc") == b.bc)), reach) for b in dense.collect()]
    every = shifts[0]
    for s in shifts[1:]:
        every = every.union(s)
    return every.agg(F.percentile("dr", F.lit(0.5)).alias("dr"), F.percentile("dc", F.lit(0.5)).alias("dc"), F.count("*").alias("samples"))


__all__ = ["first_kept", "match_campuses", "merge_places", "missing_buildings", "near_rings", "points_in_polygons", "registration", "street_context"]
