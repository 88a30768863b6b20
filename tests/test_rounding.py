"""Rounding of values that were rounded before, as the SQL rounds them."""

import duckdb
from pyspark.sql import functions as F

from lanepulse.functions.geo import rounded


def test_rounded_twice(spark):
    rows = spark.range(200_000).selectExpr("id", "id / 1000D + 0.0005D AS x").collect()  # ties at the fourth digit
    values = [round(r.x, 6) for r in rows] + [-2082.2065, -0.0005, 0.0]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").orderBy("k").select(rounded(F.col("x"), 3)).collect()]
    want = duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda v: round(v, 3))", [values]).fetchall()[0][0]
    assert got == want
