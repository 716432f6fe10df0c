"""Months of unlike schemas, manifests and stored tables."""

import pytest
from pyspark.sql import functions as F

from meterline.functions import derive
from meterline.plans.queries import QUERIES, SQL
from meterline.sources import manifest, trips
from meterline.sources.folders import stored_once
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", ["scan_bronze", "scan_bronze_all_months", "curate_unlike_months", "changed_months", "refresh_curated", "refreshed_manifest", "bronze_manifest_rows"])
def test_queries(spark, sf, con, name):
    same(con, SQL[name], QUERIES[name](spark, sf))


def test_unlike_months_keep_their_values(spark, tmp_path):
    root = str(tmp_path)
    months = {1: "(1, 2.5, 'a')", 2: "(5000000000L, 3L, 'b')", 3: "(3, 1.0f, 'c')"}
    for month, values in months.items():
        spark.sql(f"SELECT * FROM VALUES {values} AS t(PULocationID, {'Passenger_Count' if month == 3 else 'passenger_count'}, only_{'once' if month == 1 else 'twice'})").write.parquet(f"{root}/green_tripdata_2024-{month:02d}.parquet")
    rows = trips.scan_bronze(spark, root, "green", [(2024, m) for m in range(1, 7)])
    assert {f.name.lower(): f.dataType.simpleString() for f in rows.schema if f.name.lower() in ("pulocationid", "passenger_count")} == {"pulocationid": "bigint", "passenger_count": "double"}
    got = rows.orderBy("file_month").select("file_month", "PULocationID", "passenger_count", "only_once", "only_twice").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2.5, "a", None), (2, 5000000000, 3.0, None, "b"), (3, 3, 1.0, None, "c")]
    assert trips.scan_bronze(spark, root, "yellow", [(2024, 1)]) is None
    # one scan for each schema, and only the columns asked for
    plan = derive.widen_types(rows.where("file_month < 3").select("passenger_count"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and plan.count("only_once") == 0


def test_refresh_touches_changed_months_alone(spark, tmp_path):
    root, layer, told = (str(tmp_path / n) for n in ("bronze", "layer", "manifest"))
    raw = spark.range(40).select(F.lit(2024).alias("file_year"), (F.col("id") % 4 + 1).cast("int").alias("file_month"), F.current_timestamp().alias("pickup_ts"), F.lit(1).alias("PULocationID"), F.lit(2).alias("DOLocationID"), "id")
    trips.write_bronze(raw, root, "yellow")

    def curate(rows):
        return rows.select("pickup_ts", "PULocationID", "DOLocationID", "id", F.col("file_year").alias("year"), F.col("file_month").alias("month")).where("month < 4 or id < 20")

    def state():
        return {p.parent.name: p.name for p in tmp_path.glob("layer/year=2024/month=*/*.parquet")}

    assert {(r.month, r.change) for r in manifest.refresh(spark, root, "yellow", layer, told, curate).collect()} == {(m, "new") for m in range(1, 5)}
    first = state()
    assert manifest.refresh(spark, root, "yellow", layer, told, curate).count() == 0 and state() == first
    trips.write_bronze(raw.where("file_month = 2"), root, "yellow")
    # all rows of the fourth month are cleaned away now
    trips.write_bronze(raw.where("file_month = 4").withColumn("id", F.col("id") + 100), root, "yellow")
    assert {(r.month, r.change) for r in manifest.refresh(spark, root, "yellow", layer, told, curate).collect()} == {(2, "changed"), (4, "changed")}
    then = state()
    assert {k for k in first if then.get(k) != first[k]} == {"month=2", "month=4"} and "month=4" not in then
    assert {r.month: r.rows for r in manifest.stored_manifest(spark, told).groupBy("month").agg(F.sum("rows").alias("rows")).collect()} == {m: 10 for m in range(1, 5)}


def test_stored_tables_follow_their_sources(spark, tmp_path):
    path = str(tmp_path / "source")

    def stored():
        return stored_once(spark, "small", [path], lambda: spark.read.parquet(path)).count()

    spark.range(1).write.parquet(path)
    assert stored() == 1 == stored()
    spark.range(5).write.mode("overwrite").parquet(path)
    assert stored() == 5


def test_refresh_curates_each_trip_once(spark, tmp_path):
    root, layer, told = (str(tmp_path / n) for n in ("bronze", "layer", "manifest"))
    raw = spark.range(40).select(F.lit(2024).alias("file_year"), (F.col("id") % 4 + 1).cast("int").alias("file_month"), F.current_timestamp().alias("pickup_ts"), F.lit(1).alias("PULocationID"), F.lit(2).alias("DOLocationID"))
    trips.write_bronze(raw, root, "yellow")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def curate(rows):
        kept = rows.select("pickup_ts", "PULocationID", "DOLocationID", F.col("file_year").alias("year"), F.col("file_month").alias("month"))
        return kept.mapInArrow(counted, kept.schema)

    manifest.refresh(spark, root, "yellow", layer, told, curate)
    assert seen.value == 40 and spark.read.parquet(layer).count() == 40
