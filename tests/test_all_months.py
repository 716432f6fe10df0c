"""Streams and bronze files over every month of the smallest tables."""

from pyspark.sql import functions as F

from meterline.plans.queries import QUERIES
from meterline.sources import fixtures


def test_queries_without_sql_take_all_rows(spark, sf):
    rows = fixtures.raw_trips(spark, sf).count()
    assert QUERIES["late_rows"](spark, sf).agg(F.sum("rows_in"), F.sum("late_rows")).first()[:] == (rows, 0)
    assert QUERIES["bronze_manifest"](spark, sf).agg(F.sum("rows")).first()[0] == rows


def test_files_follow_the_rows_in_dropoff_order(spark, sf, tmp_path, monkeypatch):
    from meterline.functions.derive import trip_events
    from meterline.streaming import zones as streams

    monkeypatch.setattr(streams, "EVENTS", 1000)
    events = trip_events(fixtures.raw_trips(spark, sf), "yellow")
    streams.replay_stream(events, str(tmp_path / "events"))
    files = sorted((tmp_path / "events").glob("events-*.parquet"), key=lambda f: f.stat().st_mtime)
    streams.replay_stream(events.limit(10), str(tmp_path / "events"), 1, "append")
    more = sorted((tmp_path / "events").glob("events-*.parquet"), key=lambda f: f.stat().st_mtime)
    assert more[:-1] == files
    assert len(files) == -(-events.count() // 1000) and [f.name for f in files] == sorted(f.name for f in files)
