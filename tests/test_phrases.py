from pyspark.sql import functions as F

from gridmill.functions import scalars as S


def test_ties_round_as_in_sql(spark):
    """0.65 and 1.15 lie just off a tie, 0.75 and 2.25 on one."""
    minutes = [x / 20 for x in range(-200, 201)] + [1234.25, 98765.75]
    got = dict(map(tuple, spark.createDataFrame([(m,) for m in minutes], "m double").select("m", S.delta_phrase(F.col("m"))).collect()))
    assert got == {m: "about the same" if abs(m) < 0.5 else f"{abs(m):.1f} minutes {'faster' if m < 0 else 'slower'}" for m in minutes}
