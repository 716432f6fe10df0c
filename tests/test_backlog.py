"""Streams over a backlog: few state partitions, several files a trigger, events stored once, and one shuffle to number them."""

import datetime as dt
import pathlib

from meterline.functions.derive import trip_events
from meterline.plans import queries
from meterline.sources import fixtures
from meterline.streaming import zones as streams
from tests.test_trips import JANUARY, START, event, records, zone_table


def test_state_lies_in_few_partitions(spark, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "windows")
    records(spark, [event(START), event(START + dt.timedelta(hours=3))]).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        events = streams.parse_events(streams.read_event_files(spark, path))
        streams.sink_windows_parquet(streams.zone_metrics(streams.clean_stream(events, JANUARY), zone_table(spark)), out, f"{out}-checkpoint").awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (tmp_path / "windows-checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(stores) <= streams.STATE_PARTITIONS


def test_a_backlog_takes_several_files_a_trigger(spark, sf):
    told = queries.QUERIES["late_rows"](spark, sf).where("rows_in > 0").collect()
    assert len(told) == 1  # three files


def test_events_are_stored_once(spark, sf):
    assert queries._events(spark, sf).inputFiles() == queries._events(spark, sf).inputFiles()
    assert "/trip_events-" in queries._events(spark, sf).inputFiles()[0]


def test_numbering_deals_rows_once(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = trip_events(fixtures.raw_trips(spark, sf), "yellow")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # trips once, and the sizes of minutes for their sums and for the join
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("isnull(") == 0


def test_an_event_is_parsed_once(spark):
    rows = records(spark, [event(START)])
    clean = streams.clean_stream(streams.parse_events(rows), JANUARY)
    assert clean._jdf.queryExecution().executedPlan().toString().count("from_json") == 1 and clean.count() == 1
    # what is no event, and no text at all, still gives a row of nulls
    odd = spark.createDataFrame([(bytearray(b"{bad"),), (None,)], "value binary")
    assert [tuple(r) for r in streams.parse_events(odd).select("trip_id", "pickup_ts").collect()] == [(None, None)] * 2


def test_single_files_keep_little_state(spark, sf, monkeypatch):
    asked, whole = [], streams.sink_windows_parquet

    def watched(metrics, path, checkpoint, **options):
        asked.append(checkpoint)
        return whole(metrics, path, checkpoint, **options)

    monkeypatch.setattr(streams, "sink_windows_parquet", watched)
    assert queries.QUERIES["bounded_batches"](spark, sf).first().batches == 3
    stores = [p for p in (pathlib.Path(asked[0].removeprefix("file:")) / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == streams.FEW_PARTITIONS
