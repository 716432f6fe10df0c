"""Numbering of events by plain numbers, in place of texts and dates formatted for each trip."""

from pyspark.sql import functions as F

from meterline.functions import derive
from meterline.sources import fixtures
from tests.test_trips import RAW, row


def test_numbering_formats_no_month_for_its_keys(spark, sf):
    plan = derive.trip_events(fixtures.raw_trips(spark, sf), "yellow")._jdf.queryExecution().optimizedPlan().toString()
    assert "date_trunc" not in plan and plan.count("format_string(") == 1


def test_trips_of_no_month_are_numbered(spark):
    rows = spark.createDataFrame([row(), row(), row()], RAW).drop("file_year", "file_month")
    months = F.when(F.monotonically_increasing_id() % 2 == 0, F.lit(None).cast("int")).otherwise(3)
    got = derive.trip_events(rows.coalesce(1).withColumns({"file_year": F.lit(2024), "file_month": months}), "yellow")
    ids = sorted(i for (i,) in got.select(F.get_json_object("value", "$.trip_id")).collect())
    assert ids[0] == "yellow-202403-0" and len(ids) == 3 and all(i.startswith("yellow-2024null-") for i in ids[1:])
