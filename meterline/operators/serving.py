"""Key-ordered serving tables: one string key a row, sorted, so that files' statistics prune lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.derive import day_type

SEPARATOR = "#"


def name_part(name: str) -> Column:
    """A name as part of a key; one that holds the separator is an error."""
    value = F.col(name)
    return F.when(F.contains(value, F.lit(SEPARATOR)), F.raise_error(F.concat(F.lit(f"{name} holds the separator of keys: "), value))).otherwise(value)


def hour_part(hour: Column) -> Column:
    """Two digits; an hour out of range is an error."""
    return F.when(hour.between(0, 23), F.lpad(hour.cast("string"), 2, "0")).otherwise(F.raise_error(F.concat(F.lit("hour out of range: "), F.coalesce(hour.cast("string"), F.lit("none")))))


def miles_part(miles: Column) -> Column:
    """Four characters, which sort as numbers do; a distance that they can't tell is an error."""
    told = F.format_string("%04.1f", miles.cast("double"))
    return F.when((miles >= 0) & (miles < 100) & (F.length(told) == 4), told).otherwise(F.raise_error(F.concat(F.lit("distance out of range: "), F.coalesce(miles.cast("string"), F.lit("none")))))


def demand_key() -> Column:
    return F.concat_ws(SEPARATOR, name_part("pu_zone"), day_type(), hour_part(F.col("pickup_hour")))


def duration_key(weekend: Column, miles: str = "trip_distance") -> Column:
    return F.concat_ws(SEPARATOR, name_part("pu_borough"), name_part("do_borough"), day_type(weekend), hour_part(F.col("pickup_hour")), miles_part(F.col(miles)))


def daily_key() -> Column:
    return F.date_format("date", "yyyy-MM-dd")


def invalid_key_parts(rows: DataFrame, names: list[str], hour: str | None = None, miles: str | None = None) -> DataFrame:
    """The rows whose parts cannot make a key, with the reason: the separator in a name, an hour or distance out of range."""
    reason = F.lit(None).cast("string")
    if miles:
        reason = F.when(F.coalesce((F.col(miles) < 0) | (F.col(miles) >= 100), F.lit(True)), "miles").otherwise(reason)
    if hour:
        reason = F.when(F.coalesce(~F.col(hour).between(0, 23), F.lit(True)), "hour").otherwise(reason)
    for name in names:
        reason = F.when(F.contains(F.col(name), F.lit(SEPARATOR)) | F.col(name).isNull(), name).otherwise(reason)
    return rows.withColumn("reason", reason).where("reason is not null")


def demand_rows(demand: DataFrame) -> DataFrame:
    """Measures and the key's parts, as columns. Rows without a zone have no key; :func:`invalid_key_parts` lists them. Other parts that can't make a key are errors when the rows are written."""
    return demand.where("pu_zone is not null").select(demand_key().alias("row_key"), "trips", "avg_distance", "avg_duration_min", F.col("pu_borough").alias("borough"), F.col("pu_zone").alias("zone"), day_type().alias("daytype"), F.col("pickup_hour").alias("hour"))


def daily_rows(daily: DataFrame) -> DataFrame:
    return daily.select(daily_key().alias("row_key"), "trips", "revenue", "avg_fare", "avg_distance", "avg_duration_min")


def duration_rows(scored: DataFrame, minutes: str = "predicted_min") -> DataFrame:
    """Predicted minutes of a scored grid, whose day of the week stands for its kind of day."""
    return scored.select(duration_key(F.col("pickup_dow").isin(1, 7)).alias("row_key"), F.col(minutes).alias("minutes"))


#: Column families of the cells of demand, of predicted durations and of days.
FAMILIES = {"trips": "m", "avg_distance": "m", "avg_duration_min": "m", "borough": "z", "zone": "z", "daytype": "z", "hour": "z"}


DURATION_FAMILIES = {"minutes": "p"}
DAILY_FAMILIES = {c: "k" for c in ("trips", "revenue", "avg_fare", "avg_distance", "avg_duration_min")}


def cells(rows: DataFrame, families: dict[str, str]) -> DataFrame:
    """One row a cell: row_key, family:column and the value as text. A null is no cell."""
    told = [c for c in rows.columns if c in families]
    listed = F.array(*(F.struct(F.lit(f"{families[c]}:{c}").alias("cell"), F.col(c).cast("string").alias("value")) for c in told))
    return rows.select("row_key", F.explode(listed).alias("c")).select("row_key", "c.*").where("value is not null")


#: Rows of a key range.
RANGE_ROWS = 2_000_000


def write_serving_table(rows: DataFrame, path: str, splits: int | list[str] | None = None) -> None:
    """Replaces the table: key ranges in files, sorted inside, with small row groups and pages, and beside them an index of each file's first and last key.

    ``splits``: so many ranges, one for each ``RANGE_ROWS`` rows if it is None; or the keys at which a new range begins, for which rows are not sampled. A given range
    of many rows has several files.
    """
    count = rows.count() if not isinstance(splits, int) else 0
    if isinstance(splits, list):
        ranges = F.array_size(F.filter(F.array(*map(F.lit, sorted(splits))), lambda s: s <= F.col("row_key"))) if splits else F.lit(0)
        # all rows of a range in one task, or in several that follow each other
        parts = len(splits) + 1 + count // RANGE_ROWS
        ordered = rows.withColumn("range", ranges.cast("int")).repartitionByRange(parts, "range", "row_key").sortWithinPartitions("range", "row_key")
        writer = ordered.write.partitionBy("range")
    else:
        ordered = rows.repartitionByRange(splits or max(1, -(-count // RANGE_ROWS)), "row_key").sortWithinPartitions("row_key")
        writer = ordered.write
    writer.mode("overwrite").option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 1000).parquet(path)
    spark = rows.sparkSession
    keys = spark.read.schema("row_key string").parquet(path).select("row_key", F.col("_metadata.file_path").alias("file"))
    index = keys.groupBy("file").agg(F.min("row_key").alias("first"), F.max("row_key").alias("last"), F.count("*").alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/{INDEX}")


#: The folder of a serving table's index, which readers of the table's rows pass over.
INDEX = "_index"


class ServingTable:
    """A serving table as its index tells: lookups open only files whose keys can hold what is asked. The index has a row for each file, some for millions of rows."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._schema = spark.read.parquet(path).schema
        self._base = path
        self.files = sorted((r.first, r.last, r.file) for r in spark.read.parquet(f"{path}/{INDEX}").select(F.col("first"), F.col("last"), F.col("file")).collect())

    def between(self, start: str, stop: str | None, inclusive: bool = False) -> DataFrame:
        """The rows of files with keys from ``start`` up to ``stop`` (None: no end), which is part of the range if it is ``inclusive``; other rows of these files come along."""
        files = [file for first, last, file in self.files if last >= start and (stop is None or first < stop or inclusive and first == stop)]
        reader = self._spark.read.schema(self._schema).option("basePath", self._base)
        return reader.parquet(*files) if files else self._spark.createDataFrame([], self._schema)

    def get(self, key: str, columns: list[str] | None = None) -> DataFrame:
        return get_row(self.between(key, key, inclusive=True), key, columns)

    def prefix(self, prefix: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return scan_prefix(self.between(prefix, after(prefix)), prefix, columns, limit)

    def range(self, start: str, stop: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return scan_range(self.between(start, stop), start, stop, columns, limit)


def after(prefix: str) -> str | None:
    """The least string above all that begin with ``prefix``, or None."""
    kept = prefix.rstrip("\U0010ffff")
    if not kept:
        return None
    code = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)


def get_row(rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    return _columns(rows.where(F.col("row_key") == key), columns)


def scan_prefix(rows: DataFrame, prefix: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    return _ordered(rows.where(F.col("row_key").startswith(prefix)), columns, limit)


def scan_range(rows: DataFrame, start: str, stop: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Keys from ``start`` up to, not including, ``stop``."""
    return _ordered(rows.where((F.col("row_key") >= start) & (F.col("row_key") < stop)), columns, limit)


def _columns(rows: DataFrame, columns: list[str] | None) -> DataFrame:
    return rows if columns is None else rows.select("row_key", *columns)


def _ordered(rows: DataFrame, columns: list[str] | None, limit: int | None) -> DataFrame:
    rows = _columns(rows, columns).orderBy("row_key")
    return rows if limit is None else rows.limit(limit)


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def month_summary(daily: DataFrame, month: str) -> DataFrame:
    """Days, trips, revenue and busiest day of a ``YYYY-MM``; December's range ends in the next year."""
    year, number = map(int, month.split("-"))
    stop = f"{year + number // 12}-{number % 12 + 1:02d}"
    rows = daily.where((F.col("row_key") >= month) & (F.col("row_key") < stop))
    busiest = F.max_by("row_key", F.struct(F.col("trips"), -F.unix_date(F.col("row_key").cast("date")))).alias("busiest_day")
    return rows.agg(F.count("*").alias("days"), F.sum("trips").alias("trips"), F.sum("revenue").alias("revenue"), busiest)
