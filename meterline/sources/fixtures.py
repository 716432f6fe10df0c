"""Trip-shaped versions of the test tables: one trip a lineitem row, a zone a nation.

Raw and curated trips are stored once a session, as the files of months and the curated layer are in practice; queries start from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.derive import derive_trips, to_contract
from meterline.operators.enrich import enrich_zones
from meterline.operators.rules import clean_trips
from meterline.sources.folders import stored_once, stored_or_made

#: Zone names that play airports.
AIRPORTS = "NATION_1?7$"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in names]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("loc_id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"))


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_once(spark, "raw", tables(sf_dir, "lineitem"), lambda: trip_rows(spark, sf_dir))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips for what goes over them once or twice: stored only if the session has stored them."""
    return stored_or_made(spark, "raw", tables(sf_dir, "lineitem"), lambda: trip_rows(spark, sf_dir))


def trip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twenty-fifth of the rows carries one of six kinds of dirt; money and distance are exact binary fractions."""
    h = F.col("h")
    base = read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("base_ts"), F.expr("cast(l_orderkey*31+l_partkey*17+l_suppkey*7+l_linenumber as bigint)").alias("h"), F.col("l_quantity").alias("q"), "l_suppkey", "l_partkey", "l_returnflag"
    )
    p = base.withColumns({"p0": F.timestamp_seconds(F.unix_timestamp("base_ts") + h % 86400), "dur": F.col("q").cast("bigint") * 60 + 120 + h % 600, "k": h % 150, "f": 3.0 + F.col("q") * 0.75})
    k, f, returned = F.col("k"), F.col("f"), F.col("l_returnflag") == "R"

    def later(seconds):
        return F.timestamp_seconds(F.unix_timestamp("p0") + seconds)

    tip = F.when(returned, 0.0).otherwise(f * (h % 5) / 16.0)
    return p.select(
        h.alias("trip_id"), F.year("base_ts").alias("file_year"), F.month("base_ts").alias("file_month"),
        F.when(k == 0, F.lit("2098-01-01 00:00:00").cast("timestamp")).otherwise(F.col("p0")).alias("pickup_ts"),
        F.when(k == 1, later(-300)).when(k == 4, later(20)).otherwise(later(F.col("dur"))).alias("dropoff_ts"),
        (F.col("l_suppkey") % 27).cast("int").alias("PULocationID"), (F.col("l_partkey") % 27).cast("int").alias("DOLocationID"),
        F.when(k == 2, 250.0).otherwise(F.col("q") / 4.0).alias("trip_distance"), F.when(k == 5, 0.0).when(k == 6, None).otherwise((1 + h % 4).cast("double")).alias("passenger_count"),
        F.when(k == 3, -f).otherwise(f).alias("fare_amount"), tip.alias("tip_amount"), F.when(k == 3, -f).otherwise(f + 1.25 + tip).alias("total_amount"), F.when(returned, 2).otherwise(1).alias("payment_type"),
    )


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_trips(raw_trips(spark, sf_dir))


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived, cleaned and joined with zones, in the contract's columns."""
    return stored_once(spark, "curated", tables(sf_dir, "lineitem", "nation", "region"), lambda: curate(spark, sf_dir, raw_trips(spark, sf_dir)))


def model_rows(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Curated trips as far as the duration model needs them: the stored ones or, where the session has none, only these columns, made from the table and stored once."""
    sources = tables(sf_dir, "lineitem", "nation", "region")
    made = lambda: curate(spark, sf_dir, apart(raw_rows(spark, sf_dir))).select(*columns)
    return stored_or_made(spark, "curated", sources, lambda: stored_once(spark, "model_rows", sources, made))


def apart(rows: DataFrame) -> DataFrame:
    """The same rows from a generator, below which no filter on them is pushed: each condition of it would work out the whole trip again."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def curate(spark: SparkSession, sf_dir: str, raw: DataFrame) -> DataFrame:
    return to_contract(enrich_zones(clean_trips(derive_trips(raw)), zones(spark, sf_dir)), "yellow")
