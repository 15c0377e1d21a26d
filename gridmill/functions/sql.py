"""Functions for SQL: the scene transform, polygon measures, and points along a line as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.rules import _ALPHA, _E, _RADIUS, utm_scalar
from gridmill.operators.shapes import _area, _clip, _rings, rectangularity


def _numbers(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


@F.arrow_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("z", T.DoubleType())]))
def scene_point(lon: pa.Array, lat: pa.Array, origin_lon: pa.Array, origin_lat: pa.Array) -> pa.Array:
    """Scene metres of a place from an origin, in the UTM zone of the first origin: x east, z south."""
    lon, lat, lon0, lat0 = map(_numbers, (lon, lat, origin_lon, origin_lat))
    zone = int((lon0[0] + 180) // 6) + 1 if len(lon0) and np.isfinite(lon0[0]) else 31
    phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - _E * np.arctanh(_E * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    j = 2 * np.arange(1, len(_ALPHA) + 1)[:, None]
    a = np.array(_ALPHA)[:, None]
    east = eta + (a * np.cos(j * xi) * np.sinh(j * eta)).sum(0)
    north = xi + (a * np.sin(j * xi) * np.cosh(j * eta)).sum(0)
    origin = {o: utm_scalar(*o, zone) for o in set(zip(lon0.tolist(), lat0.tolist()))}
    e0, n0 = (np.array([origin[o][k] for o in zip(lon0.tolist(), lat0.tolist())]) for k in (0, 1))
    return pa.StructArray.from_arrays([pa.array(500000 + 0.9996 * _RADIUS * east - e0), pa.array(n0 - 0.9996 * _RADIUS * north)], names=["x", "z"])


@F.arrow_udf(T.DoubleType())
def inside_fraction(ring: pa.Array, x0: pa.Array, z0: pa.Array, x1: pa.Array, z1: pa.Array) -> pa.Array:
    """Share of a ring's area inside a rectangle; 0 for rings without area."""
    out = []
    for p, *box in zip(_rings(ring), *map(_numbers, (x0, z0, x1, z1))):
        whole = _area(p)
        for axis, at, sign in ((0, box[0], -1), (1, box[1], -1), (0, box[2], 1), (1, box[3], 1)):
            p = _clip(p, axis, at, sign)
        out.append(_area(p) / whole if whole else 0.0)
    return pa.array(out, pa.float64())


@F.udtf(returnType="n int, x double, z double")
class PointsAlong:
    """Points along a line (array<struct<x, z>>), a spacing apart from half a one on, `offset` metres to the right (left if negative)."""

    def eval(self, line: list[Row], spacing: float, offset: float) -> Iterator[tuple[int, float, float]]:
        if not line or spacing is None or spacing <= 0:
            return
        p = np.array([(r["x"], r["z"]) for r in line], dtype=float)
        step = np.diff(p, axis=0)
        length = np.hypot(step[:, 0], step[:, 1])
        p, step, length = p[:-1][length > 0], step[length > 0], length[length > 0]
        upto = np.cumsum(length)
        if not len(upto):
            return
        n = np.arange(int(np.ceil(np.round(upto[-1] / spacing - 0.5, 9))))
        at = (n + 0.5) * spacing
        k = np.minimum(np.searchsorted(np.round(upto / spacing - 0.5, 9), n, side="right"), len(upto) - 1)
        share = (at - upto[k] + length[k]) / length[k]
        x = p[k, 0] + share * step[k, 0] - step[k, 1] / length[k] * offset
        z = p[k, 1] + share * step[k, 1] + step[k, 0] / length[k] * offset
        yield from zip(n.tolist(), x.tolist(), z.tolist())


def register(spark: SparkSession) -> None:
    """Make scene_point, inside_fraction, rectangularity and, for LATERAL, points_along known to spark.sql."""
    spark.udf.register("scene_point", scene_point)
    spark.udf.register("inside_fraction", inside_fraction)
    spark.udf.register("rectangularity", rectangularity)
    spark.udtf.register("points_along", PointsAlong)
