"""Placement of lamps, street trees and slope plants, and instances of measured trees. Chance comes from hashed draws."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.rules import poisson
from gridmill.operators.choice import normal, pick, uniform


def _beside(t: Column, side: Column, off: Column) -> list[Column]:
    """Point t metres along a road x0, z0 -> x1, z1 of length_m, `off` metres to a side (1 right, -1 left)."""
    ux, uz = (F.col("x1") - F.col("x0")) / F.col("length"), (F.col("z1") - F.col("z0")) / F.col("length")
    return [(F.col("x0") + ux * t - uz * side * off).alias("x"), (F.col("z0") + uz * t + ux * side * off).alias("z")]


def _measured(roads: DataFrame) -> DataFrame:
    return roads.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"))).where("length > 0")


def lamps(roads: DataFrame, corner: float) -> DataFrame:
    """Lamps along one side of each road, by its number's parity, a spacing apart from the first spacing on until half a one before the end.

    roads: edge_idx, x0, z0, x1, z1, half_m, spacing. Returns edge_idx, slot, x, z.
    """
    rows = _measured(roads).withColumn("n", F.ceil(F.col("length") / F.col("spacing") - 0.5).cast("int") - 1).where("n > 0")
    rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
    side = F.when(F.col("edge_idx") % 2 == 1, 1.0).otherwise(-1.0)
    return rows.select("edge_idx", "slot", *_beside(F.col("slot") * F.col("spacing"), side, F.col("half_m") + corner))


def street_trees(roads: DataFrame, parkway: float, presence: float, seed: int) -> DataFrame:
    """Trees along both sides of each road: about a spacing apart, each there by chance, a little off the line. roads as for lamps."""
    rows = _measured(roads).where("length >= spacing").withColumn("slot", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / F.col("spacing")).cast("int"))))
    rows = rows.withColumn("side", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    key = (F.col("edge_idx"), F.col("side"))
    start = F.col("spacing") * (0.5 + 0.5 * uniform("start", seed, *key))
    t = start + F.col("slot") * F.col("spacing") * (0.85 + 0.3 * uniform("step", seed, *key, F.col("slot")))
    rows = rows.withColumn("t", t).where((F.col("t") < F.col("length") - 4) & (uniform("there", seed, *key, F.col("slot")) < presence))
    return rows.select("edge_idx", "slot", "side", *_beside(F.col("t") + 0.6 * normal("off", seed, *key, F.col("slot")), F.col("side"), F.col("half_m") + parkway))


def slope_plants(cells: DataFrame, size: float, per_m2: float, seed: int) -> DataFrame:
    """Plants on each cell, a Poisson number by its share of slope, anywhere inside. cells: row, col, share."""
    key = (F.col("row"), F.col("col"))
    n = poisson(uniform("plants", seed, *key), F.col("share") * per_m2 * size * size)
    rows = cells.withColumn("n", n).where("n > 0").withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = lambda c, name: ((F.col(c) + uniform(name, seed, *key, F.col("slot"))) * size)
    return rows.select("row", "col", "slot", at("col", "px").alias("x"), at("row", "pz").alias("z"))


def tree_context(kind: Column, building_m: Column, building: Column, road_m: Column, open_building: float, open_road: float, street: float) -> Column:
    """Mix that a tree's species is drawn from; a palm in the open is a broadleaf."""
    is_open = (building_m > open_building) & (road_m > open_road)
    broad = F.when(building.isin("commercial", "apartments", "school", "other") & (building_m < 30), "commercial").when(is_open, "open").when(road_m < street, "street").otherwise("yard")
    return F.when((kind == "palm") & ~is_open, "palm").when(kind == "conifer", "conifer").otherwise(broad)


def tree_instances(trees: DataFrame, mixes: dict[str, list[tuple[str, float, float, float]]], sigma: float, height_weight: float, scale: tuple[float, float]) -> DataFrame:
    """tree_id, species, scale. trees: tree_id, context, height, radius, u (a draw in [0, 1)).

    mixes: context to (species, weight, model height, model radius). A species'
    weight falls with the gap between the tree's log radius/height and the
    model's; the scale is the weighted geometric mean of both ratios, clamped.
    """
    aspect = F.log(F.greatest("radius", F.lit(0.3)) / F.greatest("height", F.lit(0.5)))
    u = F.col("u")
    chosen, high, wide = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for context, mix in mixes.items():
        fit = [F.lit(w) * F.exp(-F.pow(aspect - log(r0 / h0), 2) / (2 * sigma * sigma)) for _, w, h0, r0 in mix]
        chosen = F.when(F.col("context") == context, pick(u, [s for s, *_ in mix], fit)).otherwise(chosen)
    rows = trees.withColumn("species", chosen)
    for species, h0, r0 in {(s, h0, r0) for mix in mixes.values() for s, _, h0, r0 in mix}:
        high, wide = F.when(F.col("species") == species, h0).otherwise(high), F.when(F.col("species") == species, r0).otherwise(wide)
    size = F.pow(F.col("height") / high, F.lit(height_weight)) * F.pow(F.greatest("radius", F.lit(0.5)) / wide, F.lit(1 - height_weight))
    return rows.select("tree_id", "species", F.least(F.greatest(size, F.lit(scale[0])), F.lit(scale[1])).alias("scale"))
