"""Properties of the cleaning rules, derivations, plans and streams on small hand-made rows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from meterline.functions import derive
from meterline.operators import enrich, insights, rules, serving
from meterline.plans import duration
from meterline.plans.contract import EVENT
from meterline.sources import fixtures, trips
from meterline.streaming import zones as streams

RAW = "pickup_ts timestamp, dropoff_ts timestamp, trip_distance double, passenger_count double, fare_amount double, tip_amount double, total_amount double, payment_type int, file_year int, file_month int, PULocationID int, DOLocationID int"
START = dt.datetime(2024, 1, 10, 9, 0)


def row(start=START, minutes=20.0, miles=4.0, passengers=1.0, fare=15.0, tip=2.0, total=20.0, payment=1, year=2024, month=1):
    return (start, start + dt.timedelta(minutes=minutes), miles, passengers, fare, tip, total, payment, year, month, 1, 2)


def derived(spark, *rows):
    return derive.derive_trips(spark.createDataFrame(list(rows), RAW))


def test_values_of_a_clean_trip(spark):
    one = rules.clean_trips(derived(spark, row())).first()
    assert (one.duration_s, one.duration_min, one.speed_mph, one.pickup_hour, one.tip_pct, one.is_card, one.is_weekend) == (1200, 20.0, 12.0, 9, 13.33, True, False)


@pytest.mark.parametrize("bad", [dict(year=2001), dict(minutes=-5), dict(minutes=1 / 3), dict(miles=0.0), dict(miles=250.0), dict(fare=-1.0), dict(total=-1.0), dict(passengers=0.0), dict(miles=90.0)])
def test_dirty_trips_go(spark, bad):
    assert rules.clean_trips(derived(spark, row(**bad))).count() == 0


def test_null_verdicts_drop_and_count_as_bad(spark):
    rows = derived(spark, row(), row(miles=None), row(passengers=None))
    assert rules.clean_trips(rows).count() == 2
    report = {r.rule: r.bad_rows for r in rules.quality_report(rows).collect()}
    assert report["distance_out_of_range"] == 1 and report["impossible_speed"] == 1 and report["zero_passengers"] == 0


def test_quality_report_of_nothing(spark):
    assert all(r.bad_rows == 0 and r.pct is None for r in rules.quality_report(derived(spark).limit(0)).collect())


def test_nothing_divides_by_zero(spark):
    one = derived(spark, row(minutes=0, fare=0.0)).first()
    assert one.speed_mph is None and one.tip_pct is None


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_zone_join_strategies(spark, sf):
    raw, zones = fixtures.raw_trips(spark, sf), fixtures.zones(spark, sf)
    assert plan(enrich.enrich_zones(raw, zones)).count("BroadcastHashJoin") >= 2
    assert "SortMergeJoin" in plan(enrich.enrich_zones_sortmerge(raw, zones))
    assert "SortMergeJoin" in plan(enrich.enrich_zones(raw, zones, most_zones=3))


def test_partitions_prune_and_columns_too(spark, sf, tmp_path):
    path = str(tmp_path / "curated")
    trips.write_curated(fixtures.curated(spark, sf), path)
    text = plan(rules.partition_filter(trips.scan_curated(spark, path), 1995, 3).groupBy("pu_borough").count())
    assert "PartitionFilters: [isnotnull(year" in text and "ReadSchema: struct<pu_borough:string>" in text
    with pytest.raises(FileNotFoundError):
        trips.scan_curated(spark, path + "-absent")


def test_serving_filter_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "serving")
    serving.write_serving_table(spark.range(1000).select(F.format_string("k#%04d", "id").alias("row_key"), "id"), path)
    found = serving.scan_prefix(spark.read.parquet(path), "k#00")
    assert [r.id for r in found.collect()] == list(range(100))
    assert "StringStartsWith(row_key,k#00)" in plan(found)


def test_key_parts(spark):
    rows = spark.createDataFrame([("A", 1, 3.0), ("A#B", 1, 3.0), ("A", 24, 3.0), ("A", 1, 100.0), ("A", 1, None)], "zone string, hour int, miles double")
    bad = serving.invalid_key_parts(rows, ["zone"], "hour", "miles")
    assert sorted(r.reason for r in bad.collect()) == ["hour", "miles", "miles", "zone"]
    keys = spark.range(24).select(serving.hour_part(F.col("id")).alias("k"))
    assert [r.k for r in keys.orderBy("k").collect()] == [f"{h:02d}" for h in range(24)]
    for part, what in ((serving.hour_part(F.col("hour")), "hour out of range"), (serving.miles_part(F.col("miles")), "distance out of range"), (serving.name_part("zone"), "holds the separator")):
        with pytest.raises(Exception, match=what):
            rows.select(part).collect()


def test_overall_tip_share_when_payment_is_unknown(spark):
    rows = spark.createDataFrame([("X", None, 100, 50.0), ("Y", None, 300, 10.0)], "pu_borough string, is_card boolean, trips long, pct_trips_with_tip double")
    assert insights.tip_share_weighted(rows).first().asDict() == {"card": None, "cash": None, "overall": 20.0}


def test_fhvhv_money(spark):
    raw = spark.createDataFrame([(3.0, 10.0, None, 1.0, 0.5, 2.0)], "trip_miles double, base_passenger_fare double, tolls double, bcf double, sales_tax double, tips double")
    one = derive.normalise_fhvhv(raw).first()
    assert (one.fare_amount, one.total_amount, one.trip_distance, one.tip_amount) == (11.5, 13.5, 3.0, 2.0)


def event(start, minutes=10.0, zone=1, payment=1, tip=2.0):
    return dict(trip_id="t", dataset="yellow", pickup_ts=start.isoformat(), dropoff_ts=(start + dt.timedelta(minutes=minutes)).isoformat(), PULocationID=zone, DOLocationID=2, trip_distance=2.0, passenger_count=None, fare_amount=10.0, tip_amount=tip, total_amount=12.0, payment_type=payment)


def records(spark, events):
    import json

    return spark.createDataFrame([(json.dumps(e).encode(),) for e in events], "value binary")


def zone_table(spark):
    return spark.createDataFrame([(1, "ASIA", "Z1")], "loc_id int, borough string, zone string")


JANUARY = (2024, 1)


def test_events_keep_nulls_and_windows_leave_cash_tips_out(spark):
    events = streams.parse_events(records(spark, [event(START), event(START, payment=2, tip=0.0), event(START + dt.timedelta(minutes=5))]))
    assert events.columns == [f.split()[0] for f in EVENT.split(", ")] and events.first().passenger_count is None
    windows = streams.zone_metrics(streams.clean_stream(events, JANUARY), zone_table(spark), late=None).orderBy("window_start").collect()
    assert [(w.trips, w.avg_card_tip_pct, w.pu_zone) for w in windows] == [(2, 20.0, "Z1"), (1, 20.0, "Z1")]
    # the fare, not the total, is averaged; the total is summed up
    assert [(w.avg_fare, w.total_revenue) for w in windows] == [(10.0, 24.0), (10.0, 12.0)]


def test_strays_go_and_trips_over_the_end_of_a_month_stay(spark):
    stray, over, before = dt.datetime(2098, 1, 1), dt.datetime(2024, 1, 31, 23, 50), dt.datetime(2023, 12, 31, 23, 59)
    events = streams.parse_events(records(spark, [event(START), event(stray, 20), event(over, 20), event(before, 20), event(START, 1 / 3)]))
    assert sorted(r.pickup_ts for r in streams.clean_stream(events, JANUARY).collect()) == [START, over]
    assert sorted(r.pickup_ts for r in streams.clean_stream(events, (2023, 12), (2024, 1)).collect()) == [before, START, over]


def test_live_figures(spark):
    rows = [(START, START, 1, "A", "Z1", 1, 10.0, 5.0), (START, START, 2, "A", "Z2", 3, 20.0, 6.0)]
    metrics = spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, PULocationID int, pu_borough string, pu_zone string, trips long, avg_fare double, avg_duration_min double")
    assert streams.live_totals(metrics).first()[:2] == (2, 4)
    assert streams.recent_windows(metrics).first()[1:] == (4, 15.0)
    assert streams.busiest_live_zones(metrics).first()[:] == (2, "A", "Z2", 3, 20.0, 6.0)


def test_cells_leave_nulls_out(spark):
    rows = spark.createDataFrame([("k", 3, None)], "row_key string, trips long, avg_distance double")
    assert [tuple(r) for r in serving.cells(rows, serving.FAMILIES).collect()] == [("k", "m:trips", "3")]


def test_curated_months_are_split_by_their_rows(spark, sf, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the files are far too small
    trips.write_curated(fixtures.curated(spark, sf), str(tmp_path / "few"))
    trips.write_curated(fixtures.curated(spark, sf), str(tmp_path / "many"), file_rows=20)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    few, many = (len(list((tmp_path / n).glob("year=1995/month=3/*.parquet"))) for n in ("few", "many"))
    assert few == 1 < many


def test_model_errors_are_those_of_its_predictions(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("duration_min"), (F.col("id") * 1.1 + 1).alias("prediction"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("part"))

    class Same:
        def transform(self, df):
            return df

    got = duration.evaluate_model(Same(), rows, 20.0).first()
    errors = [(k * 1.1 + 1 - k) for k in range(0, 200, 5)]
    rmse = (sum(e * e for e in errors) / len(errors)) ** 0.5
    assert abs(got.rmse - rmse) < 1e-9 and abs(got.mae - sum(map(abs, errors)) / len(errors)) < 1e-9 and abs(got.improvement_pct - 100 * (1 - rmse / 20)) < 1e-9 and (got.train_rows, got.test_rows) == (160, 40)
    facts = dict(map(tuple, insights.model_findings(spark.createDataFrame([(8.0, 50.0)], "rmse double, improvement_pct double"), spark.createDataFrame([("b", 0.2), ("a", 0.7)], "feature string, importance double")).collect()))
    assert facts == {"model_gain": "50 % more accurate than the baseline (8.0 minutes of error against 16.0)", "strongest_input": "strongest predictor: a"}


def test_late_rows_are_dropped_and_restart_goes_on(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("events", "windows", "checkpoint"))

    def feed(*events):
        records(spark, events).coalesce(1).write.mode("append").parquet(path)

    def drain():
        events = streams.parse_events(streams.read_event_files(spark, path))
        told = str(tmp_path / f"progress-{uuid.uuid4().hex}")
        streams.logged(spark, told, lambda: streams.sink_windows_parquet(streams.zone_metrics(streams.clean_stream(events, JANUARY), zone_table(spark)), out, checkpoint))
        return streams.progress_rows(spark, told)

    feed(event(START))
    drain()
    feed(event(START + dt.timedelta(hours=2)))
    drain()
    feed(event(START))
    assert drain().agg(F.sum("late_rows")).first()[0] == 1
    feed(event(START + dt.timedelta(hours=4)))
    drain()
    windows = spark.read.parquet(out)
    assert windows.groupBy("window_start").count().where("count > 1").count() == 0
    assert windows.agg(F.sum("trips")).first()[0] == 2
    assert trips.committed_output(spark, out).count() >= 1


def test_text_extract_round_trip_keeps_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, 3), (None, "Z", 4)], "pu_borough string, pu_zone string, pickup_hour int")
    path = str(tmp_path / "lines")
    trips.export_tsv(rows, path)
    assert sorted(map(tuple, trips.scan_tsv(spark, path).collect()), key=str) == [("A", None, 3), (None, "Z", 4)]


def test_duration_model(spark):
    rows = spark.range(600).select(
        (F.col("id") % 20 + 1).cast("double").alias("trip_distance"), (F.col("id") % 24).cast("int").alias("pickup_hour"), (F.col("id") % 7 + 1).cast("int").alias("pickup_dow"), F.lit(1.0).alias("passenger_count"),
        F.when(F.col("id") % 3 == 0, "Slow").otherwise("Fast").alias("pu_borough"), F.lit("Fast").alias("do_borough"),
    ).withColumn("duration_min", F.col("trip_distance") * F.when(F.col("pu_borough") == "Slow", 6.0).otherwise(3.0))
    inputs = duration.feature_selection("yellow")
    model = duration.duration_pipeline(inputs, max_iter=2, depth=3).fit(rows)
    importance = {r.feature: r.importance for r in duration.feature_importance(model, rows, inputs).collect()}
    assert set(importance) == set(inputs) and abs(sum(importance.values()) - 1) < 0.01 and importance["trip_distance"] > 0.3 and importance["pu_borough"] > 0.05
    grid = duration.prediction_grid(spark, ["Slow", "Never seen"], 2)
    assert grid.count() == 24 * 2 * 2 * 4 and duration.score_grid(model, grid).where("predicted_min is null").count() == 0
    assert "passenger_count" not in duration.feature_selection("fhvhv")
    slots = duration.slot_inputs(model, rows)
    assert slots[:4] == ["trip_distance", "pickup_hour", "pickup_dow", "passenger_count"] and sorted(set(slots[4:])) == ["do_borough", "pu_borough"] and len(slots) == model.stages[-1].numFeatures
    with pytest.raises(ValueError):
        duration.feature_importance(model, rows, [c for c in inputs if c != "pu_borough"])
