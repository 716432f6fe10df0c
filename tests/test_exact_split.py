"""The cutoff of the time split is exact, whatever the number of distinct times, and where many share one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterline.operators import rules

START = dt.datetime(2024, 1, 1)


def cut(spark, seconds, share):
    rows = spark.createDataFrame([(None if s is None else START + dt.timedelta(seconds=s),) for s in seconds], "pickup_ts timestamp")
    got = rules.cutoff_of(rows, share).first()[0]
    return None if got is None else got - int(START.replace(tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("share", [0.1, 0.5, 0.8, 1.0])
def test_rank_of_the_cutoff(spark, share):
    seconds = [(k * 7919) % 200_003 for k in range(50)] + [86_400] * 7 + [None] * 3
    known = sorted(s for s in seconds if s is not None)
    assert cut(spark, seconds, share) == known[max(1, -(-len(known) * round(share * 10) // 10)) - 1]


def test_no_times(spark):
    assert cut(spark, [None, None], 0.8) is None and cut(spark, [], 0.8) is None


def test_as_exact_as_the_whole_sort(spark):
    rows = spark.range(3_000_000).select(F.timestamp_seconds(F.col("id") * 7 + 1_000_000_000).alias("pickup_ts")).repartition(7)
    assert rules.cutoff_of(rows, 0.8).first()[0] == 1_000_000_000 + 7 * (2_400_000 - 1)


def test_no_sketch_tells_the_cutoff(spark):
    rows = spark.createDataFrame([(START,)], "pickup_ts timestamp")
    assert "approx" not in rules.time_split(rows)._jdf.queryExecution().optimizedPlan().toString()
