"""Streams of many batches, running windows as a keyed table, and what a sink has committed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterline.plans.queries import QUERIES, SQL
from meterline.sources import trips
from meterline.streaming import zones as streams
from tests.oracle import connection, same
from tests.test_trips import JANUARY, START, event, records, zone_table


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", ["late_rows_total", "bounded_batches", "drain_available", "update_running_windows"])
def test_queries(spark, sf, con, name):
    same(con, SQL[name], QUERIES[name](spark, sf))


def test_progress_of_more_batches_than_a_query_remembers(spark, tmp_path):
    path, out, told = (str(tmp_path / n) for n in ("events", "windows", "progress"))
    n = 120
    records(spark, [event(START + dt.timedelta(minutes=k)) for k in range(n)]).coalesce(1).write.option("maxRecordsPerFile", 1).parquet(path)
    files = len(list((tmp_path / "events").glob("part-*.parquet")))
    events = streams.parse_events(streams.read_event_files(spark, path))
    query = streams.logged(spark, told, lambda: events.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    rows = streams.progress_rows(spark, told)
    assert files > 100 >= len(query.recentProgress)
    assert rows.where("rows_in > 0").count() == files and rows.agg(F.sum("rows_in")).first()[0] == n
    assert len(list((tmp_path / "progress").glob("progress-*.json"))) >= 2


def metric(day, hour, zone, trips_):
    start = dt.datetime(2024, 1, day, hour)
    return (start, start + dt.timedelta(hours=1), zone, "A", "Z", trips_, 1.0, 2.0, 3.0, 4.0, None)


def state(spark, path):
    return sorted(((r.window_start.day, r.window_start.hour, r.PULocationID, r.trips) for r in streams.running_windows(spark, path).collect()), key=str)


def test_running_windows_are_merged_by_key(spark, tmp_path):
    path = str(tmp_path / "windows")

    def give(number, *rows):
        streams.merge_windows(spark.createDataFrame(list(rows), streams.METRICS), path, number)

    assert state(spark, path) == []
    give(0, metric(1, 5, 1, 10), metric(1, 6, 2, 1), metric(2, 5, 1, 3))
    give(1, metric(1, 5, 1, 11), metric(1, 7, None, 2))
    want = [(1, 5, 1, 11), (1, 6, 2, 1), (1, 7, None, 2), (2, 5, 1, 3)]
    assert state(spark, path) == sorted(want, key=str)
    untouched = {p.name for p in tmp_path.glob("windows/day=2024-01-02/batch=*/*.parquet")}
    # a batch that comes again changes nothing
    give(1, metric(1, 5, 1, 11), metric(1, 7, None, 2))
    assert state(spark, path) == sorted(want, key=str)
    for k in range(2, 12):
        give(k, metric(1, 5, 1, 10 + k))
    assert (1, 5, 1, 21) in state(spark, path) and len(state(spark, path)) == 4
    # the table does not grow with the batches
    assert len(list(tmp_path.glob("windows/day=2024-01-01/batch=*"))) == 2
    assert {p.name for p in tmp_path.glob("windows/day=2024-01-02/batch=*/*.parquet")} == untouched


def test_committed_files(spark, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "windows")
    records(spark, [event(START), event(START + dt.timedelta(hours=3))]).coalesce(1).write.parquet(path)
    events = streams.parse_events(streams.read_event_files(spark, path))
    streams.sink_windows_parquet(streams.zone_metrics(streams.clean_stream(events, JANUARY), zone_table(spark)), out, f"{out}-checkpoint").awaitTermination()
    before = {r.file for r in trips.committed_output(spark, out).collect()}
    spark.range(3).write.mode("append").parquet(str(tmp_path / "other"))
    stray = next((tmp_path / "other").glob("part-*.parquet"))
    stray.rename(tmp_path / "windows" / stray.name)
    assert before and {r.file for r in trips.committed_output(spark, out).collect()} == before
    # a folder without a log has committed nothing
    assert trips.committed_output(spark, str(tmp_path / "other")).count() == 0
    assert trips.committed_output(spark, str(tmp_path / "absent")).count() == 0
