"""Tree tops and crowns against a flood on one machine."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.operators import trees as T
from gridmill.plans.tree_queries import _LEAST, _SIZE, _canopy

SF = "/root/testdata/sf0.01"
AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def flood_by_hand(cells: dict, tops: list) -> dict:
    """Cell to top: a queue by (level, steps), then each cell's first-reached neighbour's top."""
    key, queue = {}, []
    for t in tops:
        if t in cells:
            key[t] = (-cells[t], 0)
            heapq.heappush(queue, (*key[t], t))
    while queue:
        level, steps, (r, c) = heapq.heappop(queue)
        if key[r, c] != (level, steps):
            continue
        for dr, dc in AROUND:
            n = r + dr, c + dc
            if n in cells:
                new = (-cells[n], 0) if -cells[n] > level else (level, steps + 1)
                if n not in key or new < key[n]:
                    key[n] = new
                    heapq.heappush(queue, (*new, n))
    of = {t: t for t in tops if t in cells}
    for cell in sorted(key, key=key.get):
        if cell not in of:
            of[cell] = of[min(((*key[n], n) for dr, dc in AROUND if (n := (cell[0] + dr, cell[1] + dc)) in key))[2]]
    return of


def landscape():
    """Hills of all sizes on a 60 x 47 grid with holes, plateaus and negative rows."""
    rng = np.random.default_rng(4)
    hills = [(rng.uniform(0, 60), rng.uniform(0, 47), rng.uniform(4, 25), rng.uniform(1.5, 5)) for _ in range(45)]
    cells = {}
    for r in range(60):
        for c in range(47):
            v = max(h * math.exp(-((r - y) ** 2 + (c - x) ** 2) / (2 * s * s)) for y, x, h, s in hills)
            if rng.random() > 0.03:
                cells[r - 20, c - 9] = round(v * 2) / 2 if r < 30 else round(v, 6)
    return cells


@pytest.mark.parametrize("tile", [3, 16, 1000])
def test_flood_for_any_tile(spark, tile):
    cells = {k: v for k, v in landscape().items() if v >= 2}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, v double").cache()
    tops = T.tree_tops(df, 1.0)
    want = flood_by_hand(cells, [(r.row, r.col) for r in tops.collect()])
    got = {(r.row, r.col): (r.top_row, r.top_col) for r in T.flooded(df, tops, tile).where("top_row is not null").collect()}
    assert len(set(want.values())) > 10 and got == want


def test_tops_follow_height(spark):
    # 12 m high: radius 2.19 m; 24 m: 4.13 m
    rows = [(0, 0, 24.0), (0, 3, 23.0), (0, 9, 12.0), (0, 12, 11.0), (5, 0, 3.0), (5, 1, 3.0), (5, 2, 3.0), (9, 9, 1.0)]
    cells = spark.createDataFrame(rows, "row long, col long, v double")
    assert sorted(tuple(r) for r in T.tree_tops(cells, 1.0).collect()) == [(0, 0, 24.0), (0, 9, 12.0), (0, 12, 11.0), (5, 1, 3.0)]
    assert T.tree_tops(cells.where("v > 99"), 1.0).count() == 0
    assert T.crown_radius(F.lit(1.0)) is not None


def test_crowns_of_points(spark):
    cells = _canopy(spark, SF).cache()
    tops = T.tree_tops(cells, _SIZE, _LEAST).cache()
    got = {(r.row, r.col): r for r in T.crowns(cells, tops, _SIZE, 16).collect()}
    height = {(r.row, r.col): r.v for r in cells.collect() if r.v >= T.CANOPY_M}
    top = {(r.row, r.col): r.v for r in tops.collect()}
    crown = {t: [] for t in top}
    for cell, t in flood_by_hand(height, list(top)).items():
        if height[cell] >= T.CROWN_SHARE * top[t]:
            crown[t].append(height[cell])
    assert got.keys() == top.keys() and len(top) > 100
    for t, own in crown.items():
        high = max([top[t], *own])
        assert got[t].cells == len(own) and got[t].height == high
        assert got[t].radius_m == pytest.approx(math.sqrt(max(len(own), 1) * _SIZE**2 / math.pi))
        assert got[t].mean_ratio == (pytest.approx(np.mean(own) / high) if own else None)
