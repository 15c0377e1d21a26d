import pytest

from gridmill.plans.views import VIEWS, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("condition", ["true", "u < v", "u < v and highway = 'primary'"])
def test_edges_meet_by_equality(spark, condition):
    """The rows of the view's SQL, and no nested loop whatever a query asks of both ends."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    want = spark.sql(VIEWS["edges"], part=part).where(condition)
    got = table(spark, SF, "edges").where(condition)
    assert got.schema == want.schema and got.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
