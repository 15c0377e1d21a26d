import pytest
from pyspark.sql import functions as F

from gridmill.registry import ORACLE_SQL, QUERIES
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert difference(spark, SF, QUERIES[name], ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_without_sql(spark, name):
    """Their results are held against definitions elsewhere; here, that there are rows, and the same ones however Spark deals them out."""

    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = QUERIES[name](spark, SF)
            doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
            return df.withColumns({c: F.round(c, 6) for c in doubles}).agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)

    got = rows(8)
    assert got[0] > 0 and rows(3) == got
