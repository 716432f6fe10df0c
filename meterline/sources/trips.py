"""Sources and sinks of trips: raw months, curated partitions, zones, text extracts, gold tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterline.operators.serving import count_rows  # noqa: F401  (key-only counts of any table)
from meterline.sources.folders import exists, file_system

ZONE_SCHEMA = "LocationID string, Borough string, Zone string, service_zone string"
LINE_SCHEMA = "borough string, zone string, hour int"
COUNT_SCHEMA = "borough string, zone string, hour int, trips long"


def write_bronze(raw: DataFrame, root: str, dataset: str) -> list[tuple[int, int]]:
    """Each file month of ``raw`` under the name that :func:`scan_bronze` reads, all in one write; a month that is there is replaced. Gives the months."""
    spark, staged = raw.sparkSession, f"{root}/_staged-{uuid.uuid4().hex}"
    named = raw.withColumn("of_file", F.format_string("%04d-%02d", "file_year", "file_month")).drop("file_year", "file_month")
    named.write.partitionBy("of_file").parquet(staged)
    fs, path = file_system(spark, root)
    months = []
    for found in fs.listStatus(path(staged)):
        key, _, month = found.getPath().getName().partition("=")
        if key == "of_file":
            target = path(f"{root}/{dataset}_tripdata_{month}.parquet")
            fs.delete(target, True)
            if not fs.rename(found.getPath(), target):
                raise OSError(f"could not name the file of {month} in {root}")
            months.append((int(month[:4]), int(month[5:])))
    fs.delete(path(staged), True)
    return sorted(months)


#: Footers that are read at the same time.
READERS = 16


def scan_bronze(spark: SparkSession, root: str, dataset: str, months: list[tuple[int, int]]) -> DataFrame | None:
    """All given months of a dataset in one job, with file_path, and file_year and file_month from the files' names; missing months are skipped.

    Months may store a column in unlike types, spell its name in another case, or lack it. One footer a month tells its
    schema; months of one schema are one scan, and the scans one union, whose columns get the widest type of all, null where a month lacks them.
    """
    paths = [f"{root}/{dataset}_tripdata_{y}-{m:02d}.parquet" for y, m in months]
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return None
    with ThreadPoolExecutor(READERS) as readers:
        schemas = list(readers.map(lambda p: spark.read.parquet(p).schema, there))
    alike: dict[frozenset, tuple[StructType, list[str]]] = {}
    for path, schema in zip(there, schemas):
        alike.setdefault(frozenset((f.name.lower(), f.dataType.simpleString()) for f in schema), (schema, []))[1].append(path)
    of_file = F.col("_metadata.file_path").alias("file_path")
    scans = [spark.read.schema(schema).parquet(*group).select("*", of_file) for schema, group in alike.values()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return df.withColumns({name: F.regexp_extract("file_path", r"_(\d{4})-(\d{2})\.parquet", k).cast("int") for k, name in ((1, "file_year"), (2, "file_month"))})


def scan_curated(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, root):
        raise FileNotFoundError(f"no curated trips at {root}")
    return spark.read.parquet(root)


def scan_gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A gold table, or an empty one of its schema where it is absent."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ZONE_SCHEMA).option("header", True).csv(path)
    return rows.select(F.col("LocationID").try_cast("int").alias("loc_id"), F.col("Borough").alias("borough"), F.col("Zone").alias("zone"))


def scan_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def scan_quoted_csv(spark: SparkSession, path: str, schema: str = ZONE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').csv(path)


def export_tsv(curated: DataFrame, path: str) -> None:
    rows = curated.select(F.col("pu_borough").alias("borough"), F.col("pu_zone").alias("zone"), F.col("pickup_hour").alias("hour"))
    rows.write.mode("overwrite").option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "").csv(path)


def scan_tsv(spark: SparkSession, path: str, schema: str = LINE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").csv(path)


#: Rows of a curated file, about.
FILE_ROWS = 4_000_000


def write_curated(curated: DataFrame, root: str, file_rows: int = FILE_ROWS, most: int | None = None) -> None:
    """Overwrites only the partitions that ``curated`` has rows of. A month's rows go to as many files as their number asks for:
    ``most`` tells what no month has more of; without it, they are counted.
    """
    if most is None:
        most = curated.groupBy("year", "month").count().agg(F.max("count")).first()[0] or 0
    salted = curated.repartition("year", "month", F.pmod(F.xxhash64("pickup_ts", "PULocationID", "DOLocationID"), F.lit(max(1, -(-most // file_rows)))))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(root)


def write_gold(table: DataFrame, path: str) -> None:
    """One file; gold tables are small aggregates."""
    table.coalesce(1).write.mode("overwrite").parquet(path)


def write_csv_copy(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_flat_copy(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_managed_orc(df: DataFrame, name: str, partition: str = "pu_borough") -> None:
    df.write.mode("overwrite").format("orc").partitionBy(partition).saveAsTable(name)


def external_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Declares a table over existing files; partitions are found from the folders."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet")
    if "PARTITIONED BY" in spark.sql(f"SHOW CREATE TABLE {name}").first()[0]:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def show_partitions(spark: SparkSession, name: str) -> DataFrame:
    """(year, month) of a declared table's partitions, as the catalog lists them: no file is read."""
    listed_parts = spark.sql(f"SHOW PARTITIONS {name}")
    return listed_parts.select(*(F.regexp_extract("partition", rf"{key}=(\d+)", 1).cast("int").alias(key) for key in ("year", "month")))


def write_report(rows: DataFrame, path: str) -> None:
    """A nested JSON document: one array of the report's rows."""
    rows.agg(F.collect_list(F.struct("*")).alias("report")).coalesce(1).write.mode("overwrite").json(path)


def committed_output(spark: SparkSession, path: str) -> DataFrame:
    """The files that a streaming sink has committed, those without rows too; none where there is no log of commits. Spark reads the log when it lists the files; no file is opened."""
    log = exists(spark, f"{path}/_spark_metadata")
    files = spark.read.schema("committed string").parquet(path).inputFiles() if log else []
    return spark.createDataFrame([(f,) for f in files], "file string")
