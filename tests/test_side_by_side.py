"""A long backlog of bounded batches: streams side by side over shares of the topic's keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterline.plans import queries
from meterline.sources import fixtures
from meterline.streaming import zones as streams

WINDOW = ["window_start", "window_end", "PULocationID"]


@pytest.fixture
def small(monkeypatch):
    """The events of the test tables are a dozen files, and a share has three at least."""
    monkeypatch.setattr(streams, "EVENTS", 500)
    monkeypatch.setattr(streams, "SHARE_FILES", 3)


def shares_of(spark, sf):
    return streams.key_shares(fixtures.raw_rows(spark, sf).select(F.col("PULocationID").cast("string").alias("key")))


def test_batches_of_a_backlog_run_side_by_side(spark, sf, small, monkeypatch):
    told, whole = [], streams.logged_all
    monkeypatch.setattr(streams, "logged_all", lambda s, path, starts: told.append(path) or whole(s, path, starts))
    found = queries.QUERIES["bounded_batches"](spark, sf).first()
    events = fixtures.raw_trips(spark, sf).count()
    assert (found.batches, found.rows_in) == (-(-events // 500), events)
    batches = spark.read.schema(streams.PROGRESS).json(told).where("numInputRows > 0")
    runs = batches.groupBy("runId").count().collect()
    assert len(runs) > 1 and min(r["count"] for r in runs) >= 3
    # each trigger takes one file, of which a range partitioning makes about equal ones
    assert batches.agg(F.max("numInputRows")).first()[0] < 2 * 500


def test_windows_of_shares_are_whole(spark, sf, small):
    shares = shares_of(spark, sf)
    assert len(shares) > 1
    out, _ = queries._side_by_side(spark, sf, shares, "1 day", "3 hours")
    got = spark.read.schema(streams.METRICS).option("recursiveFileLookup", True).parquet(*(f"{out}/share={k}" for k in range(len(shares))))
    want = queries._batch_metrics(spark, sf)
    columns = sorted(want.columns)
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0
    assert got.groupBy(*WINDOW).count().where("count > 1").count() == 0
    # what a share does not give are the windows that its own watermark has not passed
    latest = {r.PULocationID: r.t for r in streams.clean_stream(queries._parsed(spark, sf), *queries.MONTHS).groupBy("PULocationID").agg(F.max("pickup_ts").alias("t")).collect()}
    windows = {tuple(r) for r in want.select(*WINDOW).collect()}
    for k in range(len(shares)):
        given = {tuple(r) for r in spark.read.schema(streams.METRICS).parquet(f"{out}/share={k}").select(*WINDOW).collect()}
        zones = {zone for *_, zone in given}
        passed = max(latest[zone] for zone in zones) - dt.timedelta(hours=3)
        assert given == {w for w in windows if w[2] in zones and w[1] <= passed}


def test_keys_are_dealt_to_even_shares(spark, monkeypatch):
    monkeypatch.setattr(streams, "EVENTS", 10)
    monkeypatch.setattr(streams, "SHARE_FILES", 5)
    keys = spark.range(1_000).select(F.when(F.col("id") % 20 > 0, (F.col("id") % 20).cast("string")).alias("key"))
    shares = streams.key_shares(keys)
    assert len(shares) == 20 and {files for _, files in shares} == {5}  # the missing key among them
    # one key has nearly all: it is no share's part, and the others would have too few files
    heavy = spark.range(1_000).select(F.when(F.col("id") < 970, "a").otherwise((F.col("id") % 7).cast("string")).alias("key"))
    assert [files for _, files in streams.key_shares(heavy)] == [100]
    # shares of unlike size have the files of the whole, none of them far from full
    odd = spark.range(1_003).select(F.when(F.col("id") < 617, "a").when(F.col("id") < 872, "b").otherwise("c").alias("key"))
    assert sorted(files for _, files in streams.key_shares(odd)) == [13, 26, 62]


def test_few_events_are_one_stream(spark, sf):
    assert [files for _, files in shares_of(spark, sf)] == [3]


def test_a_failed_stream_stops_the_others(spark, tmp_path):
    endless = spark.readStream.format("rate").load()
    failing = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.raise_error(F.lit("broken")))

    def start(rows, name):
        return lambda: rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / name)).start()

    with pytest.raises(Exception, match="broken"):
        streams.logged_all(spark, str(tmp_path / "told"), [start(failing, "failing"), start(endless, "endless")])
    assert not spark.streams.active


def test_a_start_leaves_the_session_as_it_was(spark, tmp_path):
    seen, found = [], streams.CHECKPOINTS

    class Writer:
        def trigger(self, **_):
            return self

        def start(self):
            seen.append((spark.conf.get(found, None), spark.conf.get("spark.sql.shuffle.partitions")))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    streams._start(Writer(), spark, str(tmp_path / "checkpoint"), None, 1)
    assert spark.conf.get(found, None) is None and spark.conf.get("spark.sql.shuffle.partitions") == before
    spark.conf.set(found, "chosen")
    try:
        streams._start(Writer(), spark, str(tmp_path / "checkpoint"), None, 1)
        assert spark.conf.get(found) == "chosen"
    finally:
        spark.conf.unset(found)
    assert seen == [(streams.LOCAL_CHECKPOINTS, "1"), ("chosen", "1")]
