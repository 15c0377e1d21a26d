"""Polygon measures that built-in expressions can't express: Arrow functions over numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rings(rings: pa.Array) -> list[np.ndarray]:
    out = []
    for r in rings:
        flat = r.values
        out.append(np.column_stack((flat.field("x").to_numpy(), flat.field("z").to_numpy())) if r.is_valid and len(r.values) else np.zeros((0, 2)))
    return out


def _area(p: np.ndarray) -> float:
    return abs(float(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]))) / 2 if len(p) > 2 else 0.0


def _clip(p: np.ndarray, axis: int, at: float, sign: int) -> np.ndarray:
    """One pass of Sutherland and Hodgman: the part where sign * (coordinate - at) <= 0. Rings are closed."""
    if len(p) < 2:
        return p
    d = sign * (p[:, axis] - at)
    out = []
    for a, b, da, db in zip(p[:-1], p[1:], d[:-1], d[1:]):
        if da <= 0:
            out.append(a)
        if da * db < 0:
            out.append(a + (b - a) * da / (da - db))
    return np.array(out + out[:1]) if out else np.zeros((0, 2))


def inside_fraction(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """Share of a ring's area inside a rectangle (x0, z0, x1, z1); 0 for rings without area."""

    @F.arrow_udf(T.DoubleType())
    def share(rings: pa.Array) -> pa.Array:
        out = []
        for p in _rings(rings):
            whole = _area(p)
            for axis, at, sign in ((0, box[0], -1), (1, box[1], -1), (0, box[2], 1), (1, box[3], 1)):
                p = _clip(p, axis, at, sign)
            out.append(_area(p) / whole if whole else 0.0)
        return pa.array(out, pa.float64())

    return share(ring)


@F.arrow_udf(T.DoubleType())
def rectangularity(rings: pa.Array) -> pa.Array:
    """Area over that of the smallest rectangle around the ring, turned along any edge; 0 for rings without area."""
    out = []
    for p in _rings(rings):
        area, best = _area(p), np.inf
        step = np.diff(p, axis=0) if len(p) > 1 else np.zeros((0, 2))
        for dx, dz in step[np.abs(step).sum(1) > 0]:
            h = np.hypot(dx, dz)
            u = p @ np.array([dx, dz]) / h
            v = p @ np.array([-dz, dx]) / h
            best = min(best, (u.max() - u.min()) * (v.max() - v.min()))
        out.append(area / best if area and best < np.inf else 0.0)
    return pa.array(out, pa.float64())


def return_profile(trees: DataFrame, points: DataFrame) -> DataFrame:
    """Returns above 2 m within each crown, and the share below half the height. trees: tree_id, x, z, radius (at most 15), height; points: x2, z2, h."""
    from gridmill.operators.spatial import within

    met = within(trees, points, 15.0).where((F.col("d") <= F.col("radius")) & (F.col("h") > 2))
    return met.groupBy("tree_id").agg(F.count("*").alias("returns"), F.avg((F.col("h") < F.col("height") / 2).cast("int")).alias("mid_frac"))
