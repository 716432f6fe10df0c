"""Serving tables with split keys and an index, checked keys, one-scan counters and seeded samples."""

import pytest
from pyspark.sql import functions as F

from meterline.operators import rules, serving
from meterline.plans.queries import QUERIES, SQL
from tests.oracle import connection, same

NAMES = ["duration_table", "duration_get", "duration_prefix", "duration_cells", "daily_cells", "sample_trips", "well_formed_lines", "show_partitions", "external_tables", "write_managed_orc", "write_serving_table", "duration_key", "demand_key"]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, sf, con, name):
    same(con, SQL[name], QUERIES[name](spark, sf))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("curated_", "zone_hour_"))]


def opened(df):
    return len(df.inputFiles())


def test_lookups_open_one_file(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(6000).select(F.format_string("%s#%04d", F.element_at(F.array(*map(F.lit, "BDFHJL")), (F.col("id") % 6 + 1).cast("int")), "id").alias("row_key"), "id")
    serving.write_serving_table(rows, path, ["C", "E", "G", "I", "K"])
    table = serving.ServingTable(spark, path)
    ranges = [r.n for r in spark.read.parquet(path).groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()]
    assert ranges == [1000] * 6 and len(table.files) >= 6
    got = table.get("D#0001")
    assert [r.id for r in got.collect()] == [1] and opened(table.between("D#0001", "D#0001", True)) == 1
    assert table.get("D#0002").count() == 0 and table.get("Z").count() == 0
    prefix = table.prefix("H#00", ["id"], 5)
    assert [r.id for r in prefix.collect()] == [3, 9, 15, 21, 27] and opened(table.between("H#00", serving.after("H#00"))) == 1
    assert [r.row_key[0] for r in table.range("B#5994", "D#0008").collect()] == ["B", "D", "D"]
    assert spark.read.parquet(path).count() == 6000


def test_the_string_after_a_prefix():
    assert [serving.after(x) for x in ("a", "a#", "\U0010ffff", "a\U0010ffff", "퟿")] == ["b", "a$", None, "b", ""]


def test_keys_are_checked_on_the_write_path(spark, tmp_path):
    columns = "pu_zone string, is_weekend boolean, pickup_hour int, pu_borough string, trips long, avg_distance double, avg_duration_min double"
    for bad in [("A#B", False, 3), ("A", False, 24)]:
        rows = serving.demand_rows(spark.createDataFrame([(*bad, "X", 1, 1.0, 1.0)], columns))
        with pytest.raises(Exception, match="separator|out of range"):
            serving.write_serving_table(rows, str(tmp_path / "bad"), 1)
    grid = spark.createDataFrame([("A", "B", 4, 7, 100.0, 5.0)], "pu_borough string, do_borough string, pickup_dow int, pickup_hour int, trip_distance double, predicted_min double")
    with pytest.raises(Exception, match="distance out of range"):
        serving.duration_rows(grid).collect()
    assert serving.duration_rows(grid.withColumn("trip_distance", F.lit(5.0))).first().row_key == "A#B#weekday#07#05.0"


def test_malformed_lines_are_counted_by_the_job_that_writes(spark, tmp_path):
    lines = spark.createDataFrame([("a\tb\t1",), ("a\tb",), ("",), (None,), ("\t\t",), ("a\tb\tc\td",)], "value string")
    path = str(tmp_path / "good")
    assert rules.write_well_formed(lines, path) == {"lines": 6, "malformed": 4}
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["\t\t", "a\tb\t1"]
    assert rules.write_well_formed(lines.limit(0), path) == {"lines": 0, "malformed": 0}


def test_samples_do_not_depend_on_partitions(spark, sf):
    from meterline.sources import fixtures

    trips = fixtures.curated(spark, sf)

    def keys(df):
        return sorted(map(str, df.select("pickup_ts", "PULocationID", "DOLocationID", "total_amount").collect()))

    one, two = rules.sample_trips(trips, 0.1), rules.sample_trips(trips.repartition(7, "total_amount"), 0.1)
    assert keys(one) == keys(two) and 0.07 < one.count() / trips.count() < 0.13
    assert set(keys(one)) <= set(keys(rules.sample_trips(trips, 0.2))) and keys(one) != keys(rules.sample_trips(trips, 0.1, seed=7))
    assert rules.sample_trips(trips, 1.0).count() == trips.count() and rules.sample_trips(trips, 0.0).count() == 0
