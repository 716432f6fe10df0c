"""What files a layer has, and which months of raw trips have changed since they were last curated.

A manifest lists each raw file with its bytes, its time and its rows. Manifests are numbered folders, each written after
the partitions that it vouches for: a refresh that fails leaves the older manifest, and the next one does its months again.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.sources.folders import file_system, listed
from meterline.sources.trips import READERS, scan_bronze, write_curated

MANIFEST = "year int, month int, file string, bytes long, modified timestamp, rows long"
_MONTH = r"_tripdata_(\d{4})-(\d{2})\.parquet"


def _month_of(path: str) -> list:
    return [F.regexp_extract(path, _MONTH, k).cast("int").alias(n) for k, n in ((1, "year"), (2, "month"))]


def present_files(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The raw files of a dataset (``MANIFEST`` without rows), from a listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    named = files.where(F.col("path").rlike(f"/{dataset}{_MONTH}"))
    return named.select(*_month_of("path"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def rows_of_files(rows: DataFrame) -> DataFrame:
    """(year, month, file, rows) of what :func:`scan_bronze` gives."""
    return rows.groupBy(*_month_of("file_path"), F.element_at(F.split("file_path", "/"), -1).alias("file")).agg(F.count("*").alias("rows"))


def bronze_manifest(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``MANIFEST`` of listed files and the scan of them; a file without rows has 0."""
    return files.join(rows_of_files(rows), ["year", "month", "file"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def layer_freshness(files: DataFrame) -> DataFrame:
    """The newest time of listed files, and their number."""
    return files.agg(F.max("modified").alias("newest"), F.count("*").alias("files"))


def stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest under ``path``, empty where there is none."""
    newest = max((name for name in listed(spark, path) if name.isdigit()), default=None)
    return spark.read.schema(MANIFEST).parquet(f"{path}/{newest}") if newest else spark.createDataFrame([], MANIFEST)


def changed_months(stored: DataFrame, present: DataFrame) -> DataFrame:
    """(year, month, change): months whose files are ``new``, ``changed`` or ``gone``; files are compared by name, bytes and time."""

    def months(files: DataFrame, name: str) -> DataFrame:
        facts = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file", "bytes", "modified")).alias("digest"))
        return files.groupBy("year", "month").agg(facts.alias(name))

    both = months(stored, "before").join(months(present, "now"), ["year", "month"], "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("before") != F.col("now"), "changed")
    return both.select("year", "month", change.alias("change")).where("change is not null")


def _month_files(spark: SparkSession, layer: str, months: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """The names of each month's files in a curated layer; no two writes give a file the same name."""
    with ThreadPoolExecutor(READERS) as readers:
        return dict(zip(months, readers.map(lambda m: listed(spark, f"{layer}/year={m[0]}/month={m[1]}"), months)))


def refresh(spark: SparkSession, root: str, dataset: str, layer: str, manifest: str, curate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Brings the curated ``layer`` up to the raw files: only changed months are read and only their partitions written or removed. Gives what had changed."""
    stored, present = stored_manifest(spark, manifest), present_files(spark, root, dataset)
    found = changed_months(stored, present).collect()  # a row a month
    if not found:
        return spark.createDataFrame([], "year int, month int, change string")
    again = sorted((r.year, r.month) for r in found if r.change != "gone")
    empty = {(r.year, r.month) for r in found}
    keys = spark.createDataFrame([(r.year, r.month) for r in found], "year int, month int")
    kept = stored.join(F.broadcast(keys), ["year", "month"], "left_anti")
    if again:
        rows = scan_bronze(spark, root, dataset, again)
        told = bronze_manifest(present.join(F.broadcast(keys), ["year", "month"], "left_semi"), rows).persist()  # a row a file
        # trips are curated once: raw rows bound those of a month, and a month whose files stay as they are got none
        most = told.groupBy("year", "month").agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0
        before = _month_files(spark, layer, again)
        write_curated(curate(rows), layer, most=most)
        now = _month_files(spark, layer, again)
        empty -= {month for month in again if now[month] != before[month]}
        kept = kept.unionByName(told)
    fs, path = file_system(spark, layer)
    for year, month in sorted(empty):
        fs.delete(path(f"{layer}/year={year}/month={month}"), True)
    number = max((int(name) for name in listed(spark, manifest) if name.isdigit()), default=0) + 1
    kept.coalesce(1).write.mode("overwrite").parquet(f"{manifest}/{number:08d}")
    if again:
        told.unpersist()
    return spark.createDataFrame([tuple(r) for r in found], "year int, month int, change string")
