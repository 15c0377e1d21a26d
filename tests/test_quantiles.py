import numpy as np
import pytest

from gridmill.operators.grid import exact_quantiles


@pytest.mark.parametrize(("most", "bins"), [(1, 2), (5, 16), (100_000, 1024)])
def test_quantiles_by_counting(spark, most, bins):
    rng = np.random.default_rng(6)
    parts = {"normal": rng.normal(size=500), "ties": rng.integers(0, 3, size=400).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "far": np.array([-1e308, *rng.normal(size=60), 1e308]), "same": np.full(90, -2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, x in parts.items() for v in x], "part string, v double")
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    if bins == 2:
        df, parts = df.where("part <> 'far'"), {k: v for k, v in parts.items() if k != "far"}  # half the range a round takes a thousand rounds
    got = {(r.part, r.share): r.value for r in exact_quantiles(df, shares, most, bins).collect()}
    assert got.keys() == {(k, q) for k in parts for q in shares}
    for (k, q), v in got.items():
        if not (k == "far" and q in (0.0, 1.0)):
            assert v == pytest.approx(np.quantile(parts[k], q)), (k, q)
