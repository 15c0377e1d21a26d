"""Ground across gaps against triangles with empty circles, found one by one."""

import itertools

import numpy as np
import pytest

from gridmill.operators import ground as G
from gridmill.plans.grid_queries import ground_by_triangles


def field(seed, rows=60, cols=50, share=0.25, hole=None):
    rng = np.random.default_rng(seed)
    keep = rng.random((rows, cols)) < share
    if hole:
        keep[hole] = False
    return {(int(r) - 7, int(c) + 3) for r, c in np.argwhere(keep)}


def run(spark, cells, **sizes):
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, z double")
    return {(r.row, r.col): r.z for r in G.triangulated(df, "z", **sizes).collect()}


def test_triangles_are_the_lowest():
    rng = np.random.default_rng(2)
    p = np.unique(rng.integers(0, 12, size=(30, 2)), axis=0)
    q = np.array([x for x in itertools.product(range(12), range(12)) if not (p == x).all(1).any()])
    index, weight = G.triangles_around(q, p)
    held = 0
    for x, i, w in zip(q, index, weight):
        if i[0] < 0:
            continue
        held += 1
        assert np.allclose(w @ p[i], x, atol=1e-5) and w.sum() == pytest.approx(1) and w.min() > -1e-5
        centre, radius = G.circles(p[i][None].astype(float))
        assert (np.hypot(*(p - centre[0]).T) >= radius[0] - 1e-6).all()  # no cell inside the circle
    assert held > 60


@pytest.mark.parametrize("tile", [16, 64])
def test_a_plane_stays_a_plane(spark, tile):
    known = field(1, hole=(slice(20, 40), slice(15, 35)))
    plane = {(r, c): 3.0 + 0.5 * r - 0.25 * c for r, c in known}
    got = run(spark, plane, tile=tile, halo=4)
    rows, cols = [r for r, _ in known], [c for _, c in known]
    assert len(got) == (max(rows) - min(rows) + 1) * (max(cols) - min(cols) + 1)
    inside = [k for k in got if min(rows) + 3 < k[0] < max(rows) - 3 and min(cols) + 3 < k[1] < max(cols) - 3]
    assert len(inside) > 1500 and max(abs(got[k] - (3.0 + 0.5 * k[0] - 0.25 * k[1])) for k in inside) < 1e-4


def test_tiles_do_not_matter(spark):
    rng = np.random.default_rng(3)
    cells = {k: float(rng.normal()) for k in sorted(field(4, share=0.1, hole=(slice(10, 35), slice(5, 30))))}
    small, large = run(spark, cells, tile=8, halo=2), run(spark, cells, tile=1000)
    assert small.keys() == large.keys() and max(abs(small[k] - large[k]) for k in small) < 1e-6
    p = np.array(sorted(cells))
    z = np.array([cells[tuple(x)] for x in p])
    hull = G.hull(spark.createDataFrame([tuple(map(int, x)) for x in p], "row long, col long"))
    q = np.array(sorted(k for k in small if k not in cells))
    index, weight = G.triangles_around(q, p)
    for x, i, w in zip(q, index, weight):
        if i[0] >= 0 and all((b - a)[0] * (x - a)[1] - (b - a)[1] * (x - a)[0] > 1e-9 for a, b in zip(hull, np.roll(hull, -1, axis=0))):
            assert small[tuple(x)] == pytest.approx(w @ z[i], abs=1e-6)


def test_few_cells(spark):
    assert run(spark, {(0, 0): 1.0, (0, 3): 4.0}) == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 4.0, (0, 3): 4.0}
    assert run(spark, {(5, 5): 2.0}) == {(5, 5): 2.0}
    assert run(spark, {(0, 0): 0.0, (0, 4): 0.0, (4, 0): 4.0, (4, 4): 4.0})[2, 2] == pytest.approx(2.0, abs=1e-4)


def test_query(spark):
    rows = ground_by_triangles(spark, "/root/testdata/sf0.001").collect()
    assert len({(r.row, r.col) for r in rows}) == len(rows) and all(1 <= r.z <= 50 for r in rows)
