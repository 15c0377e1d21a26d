"""Bare ground across gaps: linear interpolation in Delaunay triangles, in tiles.

No triangulation is built. The triangle around an empty cell is the optimum of
a small linear program: of all triangles of known cells that hold it, the one
whose lifted plane lies lowest there. A few pivots find it, for many cells at
once. Cells lie on a grid and so on common circles; a tiny weight that depends
on a cell's place alone decides between triangles as good, so that no tile
size matters. A triangle counts only if its circle lies inside the window its
tile has seen; others are looked for again in a window twice as wide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.operators.network import forget, kept
from gridmill.operators.spatial import nearest

#: Pivots after which the triangle at hand is taken (a dozen is usual), and how far an empty cell is moved so that it lies on no line between cells, in cells.
_PIVOTS = 500
_ASIDE = np.array([1.7e-6, 2.9e-6])


def _weight(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """A number up to 1e-5 that depends on the place alone."""
    h = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (col.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(float) / 2.0**24 * 1e-5


def triangles_around(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into p, weights), each n x 3, of the Delaunay triangle of p around every q; index -1 where no triangle of p holds it."""
    far = 8 * (np.abs(q[:, None] - p[None, [0, -1]]).max() + np.ptp(p, axis=0).max() + np.ptp(q, axis=0).max() + 1)
    frame = np.array([[0.0, 1.0], [-1.0, -1.0], [1.0, -1.0]]) * far
    index, weight = np.empty((len(q), 3), dtype=np.int64), np.empty((len(q), 3))
    lift = _weight(p[:, 0], p[:, 1])
    step = max(1, (1 << 21) // (len(p) + 3))
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        at = p[None] - some[:, None].astype(float)
        cost = np.concatenate(((at**2).sum(2) + lift, np.full((len(some), 3), 1e4 * far**2)), axis=1)
        at = np.concatenate((at - _ASIDE, np.broadcast_to(frame, (len(some), 3, 2))), axis=1)
        basis = np.tile(np.arange(len(p), len(p) + 3), (len(some), 1))
        open_rows = np.arange(len(some))
        for _ in range(_PIVOTS):
            corner = np.take_along_axis(at[open_rows], basis[open_rows, :, None], 1)
            m = np.concatenate((corner, np.ones((len(open_rows), 3, 1))), axis=2)
            plane = np.linalg.solve(m, np.take_along_axis(cost[open_rows], basis[open_rows], 1)[..., None])[..., 0]
            above = cost[open_rows] - (at[open_rows] @ plane[:, :2, None])[..., 0] - plane[:, 2:]
            np.put_along_axis(above, basis[open_rows], 0.0, axis=1)  # a corner's own rounding error is no reason to go on
            enter = above.argmin(1)
            lower = above[np.arange(len(open_rows)), enter] < np.where((basis[open_rows] < len(p)).all(1), -1e-9, -1e-6)
            open_rows, m, enter = open_rows[lower], m[lower], enter[lower]
            if not len(open_rows):
                break
            turned = np.swapaxes(m, 1, 2)
            held = np.linalg.solve(turned, np.broadcast_to([0.0, 0.0, 1.0], (len(open_rows), 3))[..., None])[..., 0]
            new = np.linalg.solve(turned, np.concatenate((at[open_rows, enter], np.ones((len(open_rows), 1))), axis=1)[..., None])[..., 0]
            ratio = np.where(new > 1e-12, np.maximum(held, 0) / np.where(new > 1e-12, new, 1), np.inf)
            basis[open_rows, ratio.argmin(1)] = enter
        inside = (basis < len(p)).all(1)
        corner = np.take_along_axis(at, basis[..., None], 1) + np.where(basis[..., None] < len(p), _ASIDE, 0)
        m = np.swapaxes(np.concatenate((corner, np.ones((len(some), 3, 1))), axis=2), 1, 2)
        weight[lo : lo + step] = np.linalg.solve(m, np.broadcast_to([0.0, 0.0, 1.0], (len(some), 3))[..., None])[..., 0]
        index[lo : lo + step] = np.where(inside[:, None], basis, -1)
    return index, weight


def circles(corner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of the circles through triangles (n x 3 x 2)."""
    a, b = corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]
    d = 2 * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    aa, bb = (a**2).sum(1), (b**2).sum(1)
    off = np.stack((b[:, 1] * aa - a[:, 1] * bb, a[:, 0] * bb - b[:, 0] * aa), axis=1) / d[:, None]
    return corner[:, 0] + off, np.hypot(*off.T)


def _beside_gaps(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Known cells with an empty or unseen one within two cells: only these can be corners of triangles over gaps."""
    r0, c0 = r.min() - 2, c.min() - 2
    known = np.zeros((np.ptp(r) + 5, np.ptp(c) + 5), dtype=bool)
    known[r - r0, c - c0] = True
    whole = known.copy()
    for axis in (0, 1):
        whole = np.logical_and.reduce([np.roll(whole, k, axis) for k in (-2, -1, 0, 1, 2)])
    return ~whole[r - r0, c - c0]


def _settle(tile: int, halo: int, most: int, frame: tuple[int, int, int, int], value: str):
    """Empty cells of one tile from the known cells of its window."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows[value].isna()]
        known = rows[rows[value].notna()]
        out = pd.DataFrame({"row": asked["row"], "col": asked["col"], value: np.nan, "settled": halo >= most}).reset_index(drop=True)
        if len(known) < 3:
            return out
        known = known[_beside_gaps(known["row"].to_numpy(), known["col"].to_numpy())]
        p, z = known[["row", "col"]].to_numpy(), known[value].to_numpy()
        q = asked[["row", "col"]].to_numpy()
        index, weight = triangles_around(q, p)
        found = (index >= 0).all(1)
        centre, radius = circles(p[index[found]].astype(float))
        first = np.array([rows["tr"].iloc[0], rows["tc"].iloc[0]]) * tile
        low = np.where(first - halo <= [frame[0], frame[2]], -np.inf, first - halo)
        high = np.where(first + tile - 1 + halo >= [frame[1], frame[3]], np.inf, first + tile - 1 + halo)
        seen = ((centre - radius[:, None] >= low) & (centre + radius[:, None] <= high)).all(1)
        at = np.flatnonzero(found)
        out.loc[at, value] = (weight[at] * z[index[at]]).sum(1)
        out.loc[at[seen], "settled"] = True
        if np.isinf(low).all() and np.isinf(high).all():
            out["settled"] = True
        out.loc[~out["settled"], value] = np.nan
        return out

    return run


def hull(cells: DataFrame) -> np.ndarray:
    """Corners (row, col) of the convex hull of cells, counterclockwise. Rows send their ends, strips of rows their own hull; the driver joins these, a few corners each."""

    def corners(p: np.ndarray) -> np.ndarray:
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        half = []
        for some in (p, p[::-1]):
            chain: list[np.ndarray] = []
            for x in some:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (x[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (x[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(x)
            half += chain[:-1] if len(chain) > 1 else chain
        return np.unique(np.array(half), axis=0) if len(half) < 3 else np.array(half)

    def strip(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(corners(rows[["row", "col"]].to_numpy()), columns=["row", "col"])

    ends = cells.groupBy("row").agg(F.array(F.min("col"), F.max("col")).alias("ends")).select("row", F.explode("ends").alias("col"))
    parts = ends.groupBy(F.floor(F.col("row") / 4096).alias("strip")).applyInPandas(strip, "row long, col long").toPandas()
    return corners(parts.to_numpy()) if len(parts) else np.zeros((0, 2), dtype=np.int64)


def triangulated(cells: DataFrame, value: str, tile: int = 64, halo: int = 16, most: int = 256) -> DataFrame:
    """Every cell of the frame that cells (row, col, value; null values are gaps) span: known ones as they are, gaps inside the hull of the known ones by linear interpolation in their Delaunay triangles, others from the nearest known cell (by row, then column, on ties).

    Windows grow up to `most` cells around a tile; a gap wider than that takes
    the best triangle of its window, or, without one, the nearest cell.
    """
    cells = cells.select("row", "col", F.col(value).cast("double").alias(value))
    r0, r1, c0, c1 = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    known = kept(cells.where(F.col(value).isNotNull()))
    if r0 is None or known.isEmpty():
        return cells
    width = c1 - c0 + 1
    frame = cells.sparkSession.range((r1 - r0 + 1) * width).select((F.floor(F.col("id") / width) + r0).alias("row"), (F.col("id") % width + c0).alias("col"))
    gaps = kept(frame.join(known.select("row", "col"), ["row", "col"], "left_anti"))
    edge = hull(known)
    if len(edge) > 2:
        turn = [(F.lit(int(b[0] - a[0])) * (F.col("col") - int(a[1])) - F.lit(int(b[1] - a[1])) * (F.col("row") - int(a[0]))) >= 0 for a, b in zip(edge, np.roll(edge, -1, axis=0))]
        inside = turn[0]
        for t in turn[1:]:
            inside = inside & t
    else:
        inside = F.lit(False)
    at = lambda c: F.floor(F.col(c) / tile)
    left = kept(gaps.where(inside).withColumn("tr", at("row")).withColumn("tc", at("col")))
    done = known
    schema = f"row long, col long, {value} double, settled boolean"
    while not left.isEmpty():
        wanted = left.select("tr", "tc").distinct()
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))  # noqa: E731,B023
        near = known.withColumn("tr", span("row")).withColumn("tc", span("col")).join(wanted, ["tr", "tc"], "left_semi")
        asked = left.select("row", "col", F.lit(None).cast("double").alias(value), "tr", "tc")
        tried = kept(near.select("row", "col", value, "tr", "tc").union(asked).groupBy("tr", "tc").applyInPandas(_settle(tile, halo, most, (r0, r1, c0, c1), value), schema))
        done = done.union(tried.where(F.col("settled") & F.col(value).isNotNull()).select("row", "col", value))
        old, left = left, kept(tried.where("not settled").select("row", "col").withColumn("tr", at("row")).withColumn("tc", at("col")))
        forget(old)
        halo *= 2
    rest = gaps.join(done.select("row", "col"), ["row", "col"], "left_anti").withColumn("gap", (F.col("row") - r0) * width + F.col("col") - c0)
    targets = known.select(((F.col("row") - r0) * width + F.col("col") - c0).alias("source"), F.col("col").cast("double").alias("x2"), F.col("row").cast("double").alias("z2"), value)
    asks = rest.select("gap", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("z"))
    hit = nearest(asks, targets.drop(value), "gap", "source", 4.0, digits=9).select("gap", "source")
    return done.union(rest.join(hit, "gap").join(targets.select("source", value), "source").select("row", "col", value))
