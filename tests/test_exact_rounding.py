"""A trip's rounding without decimals where a double is clear."""

import math

from pyspark.sql import functions as F

from meterline.functions import derive


def test_rounding_is_that_of_decimals(spark):
    near = [k / 200 + d for k in range(-41, 42) for d in (0.0, 4e-7, 5e-7, -4e-7, -5e-7, 6e-7, 9.9e-6, -9.9e-6, 1.1e-5, 1e-9, -1e-9)]
    odd = [2.675, 1.005, 0.285, 1e9, 1e9 + 0.125, 99999999.995, 1e7 - 0.005, 1e11 + 0.5, 1e12, -1e12, 1e300, -1e300, 1e-300, -0.0, -0.001, math.nan, math.inf, -math.inf, None]
    rows = spark.createDataFrame([(x,) for x in near + odd], "x double").select("x", F.rand(7).alias("r"))
    many = rows.unionByName(spark.range(20000).select((F.rand(1) * 2000 - 1000).alias("x"), F.lit(0.0).alias("r")))
    exact = F.round(F.col("x").try_cast("decimal(18,6)"), 2).cast("double")
    pairs = many.select("x", derive.rounded_row(F.col("x"), 2).alias("got"), exact.alias("want")).collect()
    assert [(p.x, p.got, p.want) for p in pairs if repr(p.got) != repr(p.want)] == []


def test_clear_values_need_no_decimal(spark):
    rows = spark.range(1).select(F.lit(12.3456).alias("x"), F.rand(1).alias("r")).select((F.col("x") + F.col("r")).alias("y"))
    assert "CASE WHEN" in rows.select(derive.rounded_row(F.col("y"), 2))._jdf.queryExecution().optimizedPlan().toString()
