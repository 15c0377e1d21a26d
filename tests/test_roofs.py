"""Planted roofs, turned and noisy, are found again."""

import math

import numpy as np
import pytest

from gridmill.operators import roofs as R

KINDS = ["flat", "shed", "gable", "hip", "complex"]


def planted(kind: str, turn: float, pitch: float, rng, w=16.0, d=24.0, junk=0.08):
    """Points and outline of a roof w wide, its ridge along `turn` degrees from north, with noise and points off the roof."""
    n = 900
    u, v = rng.uniform(-w / 2, w / 2, n), rng.uniform(-d / 2, d / 2, n)
    down = {"flat": 0 * u, "shed": u + w / 2, "gable": abs(u), "hip": np.maximum(abs(u), abs(v) - (d - w) / 2), "complex": np.minimum(abs(u), abs(v))}[kind]
    h = 12 - down * math.tan(math.radians(pitch)) + rng.normal(0, 0.04, n)
    h[: int(junk * n)] += rng.uniform(0.5, 4, int(junk * n))  # chimneys and branches
    a = math.radians(turn)
    spin = lambda p, q: (p * math.cos(a) + q * math.sin(a) + 500, -p * math.sin(a) + q * math.cos(a) - 300)
    ring = [tuple(map(float, spin(p, q))) for p, q in ((-w / 2, -d / 2), (w / 2, -d / 2), (w / 2, d / 2), (-w / 2, d / 2), (-w / 2, -d / 2))]
    return np.column_stack((*spin(u, v), h)), ring


def test_planted_roofs(spark):
    rng = np.random.default_rng(12)
    points, prints, want = [], [], {}
    for b in range(40):
        kind, turn, pitch = KINDS[b % 5], float(rng.uniform(0, 180)), float(rng.uniform(15, 40))
        p, ring = planted(kind, turn, pitch, rng)
        points += [(b, *map(float, q)) for q in p]
        prints.append((b, ring[::-1] if b % 2 else ring))
        want[b] = kind, pitch, turn
    got = R.roof_models(spark.createDataFrame(points, "building_id long, x double, y double, h double"), spark.createDataFrame(prints, "building_id long, ring array<struct<x:double,y:double>>")).collect()
    assert len(got) == 40
    for r in got:
        kind, pitch, turn = want[r.building_id]
        assert r.roof == kind, r
        assert 0.85 < r.covered <= 1 and r.rmse < 0.1
        if kind == "flat":
            assert r.pitch_deg < 2 and r.ridge_deg is None
            continue
        assert abs(r.pitch_deg - pitch) < 2, r
        if kind != "complex":
            assert R.gap_deg(2 * r.ridge_deg, 2 * turn) / 2 < 2, (r, turn)


def test_merging_growing_and_facings():
    rng = np.random.default_rng(1)
    p = np.column_stack((rng.uniform(0, 10, 400), rng.uniform(0, 10, 400), np.full(400, 3.0)))
    label = np.where(p[:, 0] < 3, 0, np.where(p[:, 0] < 7, 1, -1))
    planes, merged = R._merged([np.array([0, 0, 3.0]), np.array([0.01, 0, 2.98])], label, p)
    assert len(planes) == 1 and set(merged) == {-1, 0}
    assert (R._grown(planes, merged, p, 0.18) == 0).all()  # outwards, further than one neighbour's reach
    apart, _ = R._merged([np.array([0, 0, 3.0]), np.array([0, 0, 4.0])], label, p)
    assert len(apart) == 2
    ways = R.facings(np.array([350.0, 10.0, 180.0, 200.0]), np.array([1.0, 1.0, 5.0, 5.0]))
    assert [w for _, w in ways] == [10.0, 2.0] and R.gap_deg(ways[1][0], 0) < 1e-6 and abs(ways[0][0] - 190) < 1e-6


def test_too_few_points_and_no_outline(spark):
    rng = np.random.default_rng(3)
    p, _ = planted("hip", 30, 25, rng)
    rows = [(1, 0.0, 0.0, 3.0), (1, 1.0, 0.0, 3.0), *((2, *map(float, q)) for q in p)]
    points = spark.createDataFrame(rows, "building_id long, x double, y double, h double")
    prints = spark.createDataFrame([(3, [(0.0, 0.0)]), (2, None)], "building_id long, ring array<struct<x:double,y:double>>")
    got = {r.building_id: r for r in R.roof_models(points, prints).collect()}
    assert got.keys() == {1, 2} and got[1].roof == "unknown" and got[1].pitch_deg is None
    assert got[2].roof == "complex" and got[2].eave_share is None
    planes = R.roof_planes(points).where("building_id = 2").orderBy("plane").collect()
    assert [r.plane for r in planes] == [0, 1, 2, 3] and all(abs(r.slope_deg - 25) < 2 for r in planes)
    assert R.roof_models(points.limit(0), prints).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_same_planes_in_any_order(seed):
    import pandas as pd

    p, _ = planted("gable", 70, 30, np.random.default_rng(5))
    frame = pd.DataFrame(p, columns=["x", "y", "h"]).assign(building_id=9)
    want = R._planes(frame, 0.18, 12, 12, 150)[1]
    assert np.array_equal(R._planes(frame.sample(frac=1, random_state=seed), 0.18, 12, 12, 150)[1], want)
