"""A query alone stores no more than it goes over again, and a batch of windows asks only for folders that are there."""

import pytest

from meterline.functions import derive
from meterline.plans import duration, queries
from meterline.sources import fixtures, folders
from meterline.streaming import zones as streams
from tests.oracle import connection, same
from tests.test_streams import metric


@pytest.fixture
def stored(monkeypatch):
    """The names of what is stored, in a session that has stored nothing."""
    names, whole = [], folders.stored_once

    def watched(spark, name, sources, make):
        names.append(name)
        return whole(spark, name, sources, make)

    monkeypatch.setattr(folders, "_STORED", {})
    monkeypatch.setattr(fixtures, "stored_once", watched)
    monkeypatch.setattr(queries, "stored_once", watched)
    return names


@pytest.mark.parametrize("name", ["zone_metrics", "zone_metrics_all_months", "recent_windows", "recent_windows_all_months"])
def test_a_batch_stores_no_events(spark, sf, stored, name):
    got = queries.QUERIES[name](spark, sf)
    assert stored == []
    same(connection(sf), queries.SQL[name], got)


def test_events_are_stored_without_raw_trips(spark, sf, stored):
    queries._events(spark, sf)
    assert stored == ["trip_events"]
    assert queries._parsed(spark, sf).inputFiles() == queries._events(spark, sf).inputFiles()  # what is stored is read


def test_the_model_stores_its_columns(spark, sf, stored, monkeypatch):
    whole = duration.duration_pipeline
    monkeypatch.setattr(duration, "duration_pipeline", lambda inputs, weight=None: whole(inputs, max_iter=1, depth=2, weight=weight))
    assert queries.QUERIES["fastest_hour"](spark, sf).count() == 1
    assert stored == ["model_rows"]
    columns = ["trip_distance", "pu_borough", "do_borough", "passenger_count", "pickup_ts"]
    narrow = fixtures.model_rows(spark, sf, columns).select(*columns).collect()
    assert sorted(map(str, narrow)) == sorted(map(str, fixtures.curated(spark, sf).select(*columns).collect()))


def test_events_are_numbered_by_few_groups(spark, sf):
    plan = derive.trip_events(fixtures.raw_trips(spark, sf), "yellow")._jdf.queryExecution().optimizedPlan().toString()
    assert "div 3600" in plan


def test_new_days_are_not_listed(spark, tmp_path, monkeypatch):
    path, asked, whole = str(tmp_path / "windows"), [], streams.listed

    def watched(spark, folder):
        asked.append(folder)
        return whole(spark, folder)

    monkeypatch.setattr(streams, "listed", watched)
    streams.merge_windows(spark.createDataFrame([metric(k, 5, 1, 10) for k in (1, 2, 3)], streams.METRICS), path, 0)
    assert asked == [path]
    streams.merge_windows(spark.createDataFrame([metric(3, 5, 1, 11), metric(4, 5, 1, 1)], streams.METRICS), path, 1)
    assert asked == [path, path, f"{path}/day=2024-01-03"]


def test_many_days_are_listed_by_few_tasks(spark, tmp_path):
    path, name = str(tmp_path / "windows"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(name), spark.sparkContext.statusTracker()
    # more days than Spark lists without a job
    streams.merge_windows(spark.range(60).selectExpr(
        "timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as window_start", "timestamp'2024-01-02' + make_dt_interval(cast(id as int)) as window_end", "1 as PULocationID", "'a' as pu_borough", "'b' as pu_zone",
        "1L as trips", "1d as avg_fare", "1d as avg_duration_min", "1d as avg_distance", "1d as total_revenue", "1d as avg_card_tip_pct"), path, 0)
    spark.sparkContext.setJobGroup("days", "days")
    try:
        rows = streams.running_windows(spark, path)
        stages = [tracker.getStageInfo(k) for job in tracker.getJobIdsForGroup("days") for k in tracker.getJobInfo(job).stageIds]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert spark.conf.get(name) == before and rows.count() == 60
    assert stages and max(stage.numTasks for stage in stages) <= streams.LISTERS
