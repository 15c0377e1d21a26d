import pytest
from pyspark.sql import functions as F

from gridmill.operators import spatial as S


def test_centroid_and_zones(spark):
    bent = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0), (0.0, 0.0)]  # an L of area 7
    far = [(x + 1e6, z - 1e6) for x, z in bent]
    tiny = [(2.1, 2.1), (2.2, 2.1), (2.2, 2.2), (2.1, 2.2), (2.1, 2.1)]
    away = [(x + 90, z) for x, z in tiny]
    rings = spark.createDataFrame([(1, bent), (2, far[::-1]), (3, tiny), (4, away)], "k long, ring array<struct<x:double,z:double>>")
    x, z = S.ring_centroid(F.col("ring"))
    got = {r.k: (r.x, r.z) for r in rings.select("k", x.alias("x"), z.alias("z")).collect()}
    assert got[1] == pytest.approx((9.5 / 7, 9.5 / 7)) and got[2] == pytest.approx((1e6 + 9.5 / 7, -1e6 + 9.5 / 7), abs=1e-6)
    # cells of 1 m, row 0 at z = 4; the value is column + 10 x row, the corner (3, 0) has none
    cells = spark.createDataFrame([(r, c, float(c + 10 * r), 2) for r in range(4) for c in range(4) if (r, c) != (3, 0)], "row long, col long, v double, n long")
    out = {r.k: r for r in S.zonal_cells(rings.where("k <> 2"), cells, "k", 0.0, 4.0, 1.0).collect()}
    assert (out[1].covered, out[1].points, out[1].median) == (7, 12, 25.5) and out[1].cover == pytest.approx(6 / 7) and out[1].density == pytest.approx(12 / 7)
    assert (out[3].covered, out[3].median, out[3].ridge, out[3].cover) == (0, 12.0, 12.0, None)
    assert (out[4].covered, out[4].median) == (0, None)
