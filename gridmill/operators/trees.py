"""Trees in a canopy height raster: tops by a window that follows height, crowns by flooding from the tops.

Cells are rows (row, col, v: height); empty cells have no row and stand for no
canopy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.operators.grid import neighbours
from gridmill.operators.network import connected, forget, kept
from gridmill.operators.spatial import within

# The crown width model (metres, of height in metres), its limits as a radius, the least canopy
# height, the share of its top's height that a crown cell keeps, and how close to the largest neighbour a peak is.
CROWN_WIDTH = (3.09632, 0.00895)
CROWN_RADIUS = (1.0, 5.0)
CANOPY_M = 2.0
CROWN_SHARE = 0.4
PEAK_TIE = 1e-4


def crown_radius(height: Column) -> Column:
    """Search radius in metres for a tree of a height."""
    wide = F.lit(CROWN_WIDTH[0]) + F.lit(CROWN_WIDTH[1]) * height * height
    return F.least(F.greatest(wide / 2, F.lit(CROWN_RADIUS[0])), F.lit(CROWN_RADIUS[1]))


def smoothed(cells: DataFrame, value: str, sigma: float, digits: int = 6) -> DataFrame:
    """Gaussian mean over cells, up to four sigmas away; empty cells count as 0. sigma in cells."""
    reach = int(4 * sigma + 0.5)
    weight = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    total = sum(weight.values())
    g = lambda c: F.element_at(F.create_map(*[x for k, w in weight.items() for x in (F.lit(k), F.lit(w / total))]), F.col(c))
    blurred = neighbours(cells.select("row", "col", value), reach).groupBy("row", "col").agg(F.sum(F.col(value) * g("dr") * g("dc")).alias("s"))
    return cells.join(blurred, ["row", "col"]).withColumn(value, F.round("s", digits)).drop("s")


def tree_tops(cells: DataFrame, cell_m: float, least_m: float = CANOPY_M) -> DataFrame:
    """Tops: row, col, v. Peaks of 3 x 3 cells, at least `least_m` high, without a higher peak within the crown radius of their height.

    Peaks that touch are one, at their mean place and of their greatest height;
    of peaks as high the first by row, then column, goes before.
    """
    around = neighbours(cells.select("row", "col", "v")).groupBy("row", "col").agg(F.max("v").alias("most"))
    peaks = kept(cells.select("row", "col", "v").where(F.col("v") >= least_m).join(around, ["row", "col"]).where(F.col("v") >= F.col("most") - PEAK_TIE).select("row", "col", "v"))
    # a peak's number follows row and column, so that the least of a plateau is its first cell
    low, wide = peaks.agg(F.min("col"), F.max("col") - F.min("col") + 1).first()
    if low is None:
        return peaks
    number = F.col("row") * F.lit(wide) + F.col("col") - F.lit(low)
    at = peaks.select(number.alias("node_id"), "row", "col", "v")
    told = neighbours(at.select("row", "col", F.col("node_id").alias("other")), centre=False)
    touching = at.join(told.select("row", "col", "other"), ["row", "col"]).select(F.col("node_id").alias("u"), F.col("other").alias("v"))
    clumps = connected(touching)
    whole = at.join(clumps, "node_id", "left").withColumn("first", F.coalesce("component", "node_id"))
    tops = kept(whole.groupBy("first").agg(F.rint(F.avg("row")).cast("long").alias("row"), F.rint(F.avg("col")).cast("long").alias("col"), F.max("v").alias("v")))
    mine = tops.select("first", (F.col("col") * cell_m).alias("x"), (F.col("row") * cell_m).alias("z"), "v")
    others = tops.select(F.col("first").alias("other"), (F.col("col") * cell_m).alias("x2"), (F.col("row") * cell_m).alias("z2"), F.col("v").alias("other_v"))
    met = within(mine, others, CROWN_RADIUS[1]).where(F.col("d") <= crown_radius(F.col("v")) + 1e-9)
    beaten = met.where((F.col("other_v") > F.col("v")) | ((F.col("other_v") == F.col("v")) & (F.col("other") < F.col("first"))))
    return tops.join(beaten.select("first"), "first", "left_anti").select("row", "col", "v")


_STEPS = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def _flood(frame: pd.DataFrame) -> pd.DataFrame:
    """Levels and steps of one tile's own cells, from its tops and from what the cells around it have."""
    r, c = (frame[k].to_numpy() for k in ("row", "col"))
    r, c = r - r.min() + 1, c - c.min() + 1
    shape = r.max() + 2, c.max() + 2
    depth, level, steps = np.full(shape, np.inf), np.full(shape, np.inf), np.zeros(shape, dtype=np.int64)
    own = frame["own"].to_numpy()
    depth[r[own], c[own]] = -frame["v"].to_numpy()[own]
    level[r, c], steps[r, c] = frame["level"].to_numpy(), frame["steps"].to_numpy()
    inner = (slice(1, -1), slice(1, -1))
    while True:
        best, best_steps = np.full((shape[0] - 2, shape[1] - 2), np.inf), np.zeros((shape[0] - 2, shape[1] - 2), dtype=np.int64)
        for dr, dc in _STEPS:
            near = (slice(1 + dr, shape[0] - 1 + dr), slice(1 + dc, shape[1] - 1 + dc))
            less = (level[near] < best) | (level[near] == best) & (steps[near] < best_steps)
            best, best_steps = np.where(less, level[near], best), np.where(less, steps[near], best_steps)
        rises = depth[inner] > best
        new, new_steps = np.where(rises, depth[inner], best), np.where(rises, 0, best_steps + 1)
        less = np.isfinite(depth[inner]) & np.isfinite(best) & ((new < level[inner]) | (new == level[inner]) & (new_steps < steps[inner]))
        if not less.any():
            break
        level[inner][less], steps[inner][less] = new[less], new_steps[less]
    out = frame[own].copy()
    out["level"], out["steps"] = level[r[own], c[own]], steps[r[own], c[own]]
    out["fresh"] = (out["level"] != frame["level"][own]) | (out["steps"] != frame["steps"][own])
    return out.drop(columns="own")


def flooded(cells: DataFrame, tops: DataFrame, tile: int = 64, max_rounds: int = 1000) -> DataFrame:
    """Cells with the top whose flood comes first: row, col, v, top_row, top_col; cells that no flood comes to have none.

    The flood starts at the tops and sinks: a cell is reached from its neighbour
    that was reached first, at that neighbour's level or, if lower, its own
    height; on one level after the steps taken there. Of neighbours reached at
    once the first by row, then column, passes its top on. cells: row, col, v.

    A round floods whole tiles, a task each, and tells the cells along their
    rims to the tiles beside them; levels only sink, so the order of tiles
    doesn't matter. Rounds follow the tiles a crown reaches over.
    """
    at = lambda c: F.floor(F.col(c) / tile)
    marked = tops.select("row", "col", F.lit(True).alias("top"))
    start = cells.select("row", "col", F.col("v").cast("double").alias("v")).join(marked, ["row", "col"], "left")
    start = start.select(at("row").alias("tr"), at("col").alias("tc"), "row", "col", "v", F.when(F.col("top"), -F.col("v")).otherwise(F.lit(float("inf"))).alias("level"), F.lit(0).cast("long").alias("steps"), F.col("top").isNotNull().alias("fresh"))
    schema = "tr long, tc long, row long, col long, v double, level double, steps long, fresh boolean"
    now = kept(start)
    for _ in range(max_rounds):
        if now.where("fresh").isEmpty():
            break
        fresh = now.where("fresh")
        own = now.withColumn("own", F.lit(True))
        # the rims around every tile that has news or gets some
        news = fresh.select(F.explode(F.array(*[F.struct(at_r.alias("tr"), at_c.alias("tc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) for at_r, at_c in [(F.floor((F.col("row") + dr) / tile), F.floor((F.col("col") + dc) / tile))]])).alias("t")).select("t.tr", "t.tc").distinct()
        beside = now.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))).where(F.col("level") < float("inf"))
        around = F.array_distinct(F.array(*[F.struct(F.floor((F.col("row") + dr) / tile).alias("r"), F.floor((F.col("col") + dc) / tile).alias("c")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]))
        rims = beside.withColumn("t", F.explode(around)).where((F.col("t.r") != F.col("tr")) | (F.col("t.c") != F.col("tc")))
        rims = rims.select(F.col("t.r").alias("tr"), F.col("t.c").alias("tc"), "row", "col", "v", "level", "steps", "fresh", F.lit(False).alias("own"))
        moved = own.unionByName(rims).join(news, ["tr", "tc"], "left_semi").groupBy("tr", "tc").applyInPandas(_flood, schema)
        calm = now.join(news, ["tr", "tc"], "left_anti").withColumn("fresh", F.lit(False))
        old, now = now, kept(calm.unionByName(moved))
        forget(old)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    reached = now.where(F.col("level") < float("inf"))
    order = F.struct("level", "steps", F.col("from_row").alias("r"), F.col("from_col").alias("c"))
    told = neighbours(reached.select("row", "col", "level", "steps", F.col("row").alias("from_row"), F.col("col").alias("from_col")), centre=False)
    first = told.groupBy("row", "col").agg(F.min(order).alias("f"))
    place = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    ways = reached.join(marked, ["row", "col"], "left").join(first, ["row", "col"], "left")
    ways = kept(ways.select(place("row", "col").alias("at"), F.when(F.col("top"), place("row", "col")).otherwise(F.struct(F.col("f.r").alias("r"), F.col("f.c").alias("c"))).alias("to")))
    while True:  # each round doubles the steps that lead to the top
        onward = kept(ways.join(ways.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        forget(ways)
        ways = onward.drop("moved")
        ways.kept_path = onward.kept_path
        if onward.where("moved").isEmpty():
            break
    tops_of = ways.select("at.*", F.col("to.r").alias("top_row"), F.col("to.c").alias("top_col"))
    return cells.select("row", "col", "v").join(tops_of.select(F.col("r").alias("row"), F.col("c").alias("col"), "top_row", "top_col"), ["row", "col"], "left")


def crowns(cells: DataFrame, tops: DataFrame, cell_m: float, tile: int = 64) -> DataFrame:
    """Per top: height, crown radius in metres and mean over top height of its crown.

    Crowns are floods over canopy cells, without cells below a share of their
    top's height. A crown has at least the area of a cell.
    """
    canopy = cells.where(F.col("v") >= CANOPY_M)
    of = flooded(canopy, tops, tile).where("top_row is not null")
    high = tops.select(F.col("row").alias("top_row"), F.col("col").alias("top_col"), F.col("v").alias("top_v"))
    held = of.join(high, ["top_row", "top_col"]).where(F.col("v") >= CROWN_SHARE * F.col("top_v"))
    sums = held.groupBy("top_row", "top_col").agg(F.count("*").alias("cells"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    out = high.join(sums, ["top_row", "top_col"], "left").withColumn("height", F.greatest("top_v", "most"))
    radius = F.sqrt(F.greatest(F.coalesce("cells", F.lit(1)), F.lit(1)) * cell_m * cell_m / F.pi())
    return out.select(F.col("top_row").alias("row"), F.col("top_col").alias("col"), "height", F.coalesce("cells", F.lit(0)).alias("cells"), radius.alias("radius_m"), (F.col("mean") / F.col("height")).alias("mean_ratio"))
