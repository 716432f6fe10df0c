"""The named cleaning rules, the filter made of them and the one-pass quality report.

A rule is a condition that keeps a row. A verdict of NULL drops the row and counts as bad.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from meterline.functions.derive import rounded
from meterline.plans.contract import DEFAULTS, Thresholds


def rule_out_of_month() -> Column:
    """Pickup lies in the month that the file is of; the month comes with each row, so many files go in one job."""
    return (F.year("pickup_ts") == F.col("file_year")) & (F.month("pickup_ts") == F.col("file_month"))


def rule_dropoff_before_pickup() -> Column:
    return F.col("dropoff_ts") > F.col("pickup_ts")


def rule_duration_out_of_range(t: Thresholds = DEFAULTS) -> Column:
    return F.col("duration_s").between(t.least_seconds, t.most_seconds)


def rule_distance_out_of_range(t: Thresholds = DEFAULTS) -> Column:
    return (F.col("trip_distance") > 0) & (F.col("trip_distance") <= t.most_miles)


def rule_negative_money() -> Column:
    return (F.col("fare_amount") >= 0) & (F.col("total_amount") >= 0)


def rule_impossible_speed(t: Thresholds = DEFAULTS) -> Column:
    return F.col("speed_mph") <= t.most_mph


def rule_zero_passengers() -> Column:
    """An unknown number of passengers is kept."""
    return F.coalesce(F.col("passenger_count"), F.lit(1.0)) > 0


def rules(t: Thresholds = DEFAULTS) -> dict[str, Column]:
    return {
        "out_of_month": rule_out_of_month(), "dropoff_before_pickup": rule_dropoff_before_pickup(), "duration_out_of_range": rule_duration_out_of_range(t), "distance_out_of_range": rule_distance_out_of_range(t),
        "negative_money": rule_negative_money(), "impossible_speed": rule_impossible_speed(t), "zero_passengers": rule_zero_passengers(),
    }


def clean_trips(derived: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return derived.where(reduce(Column.__and__, rules(t).values()))


def quality_report(derived: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """rule, rows and pct of all rows that fail it; one scan for all rules. Rules overlap, so rows do not add up."""
    bad = {name: F.count_if(~F.coalesce(keep, F.lit(False))).alias(name) for name, keep in rules(t).items()}
    one = derived.agg(F.count("*").alias("total"), *bad.values())
    stack = ", ".join(f"'{name}', {name}" for name in bad)
    return one.selectExpr("total", f"stack({len(bad)}, {stack}) AS (rule, bad_rows)").select("rule", "bad_rows", rounded(F.try_divide(100 * F.col("bad_rows"), F.col("total")), 3).alias("pct"))


def curate_stats(derived: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Rows in, out and removed for each file month."""
    keep = F.coalesce(reduce(Column.__and__, rules(t).values()), F.lit(False))
    counts = derived.groupBy("file_year", "file_month").agg(F.count("*").alias("rows_in"), F.count_if(keep).alias("rows_out"))
    removed = F.col("rows_in") - F.col("rows_out")
    return counts.withColumns({"removed": removed, "removed_pct": rounded(100 * removed / F.col("rows_in"), 3)})


def partition_filter(curated: DataFrame, year: int, month: int) -> DataFrame:
    return curated.where((F.col("year") == year) & (F.col("month") == month))


def airport_filter(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("pu_zone").rlike(pattern) | F.col("do_zone").rlike(pattern))


def feature_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


#: What tells trips apart in samples.
SAMPLE_KEY = ("pickup_ts", "dropoff_ts", "PULocationID", "DOLocationID")


def sample_trips(df: DataFrame, fraction: float, seed: int = 42, key: tuple[str, ...] = SAMPLE_KEY) -> DataFrame:
    """A row stays if a seeded hash of its key is below the fraction: the same rows however they are dealt over partitions, and more of them, not others, for a larger fraction."""
    kinds = dict(df.dtypes)
    parts = [F.unix_seconds(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c) for c in key]
    hashed = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 8)
    return df.where(hashed < F.lit(f"{min(int(fraction * 2**32), 2**32 - 1):08x}")) if fraction < 1 else df


def cutoff_of(df: DataFrame, share: float) -> DataFrame:
    """(cutoff): the least second of pickup that ``share`` of the known ones do not pass, exactly; null without any.

    Days are counted first: their running sums, a row a day, tell the day of the cutoff, and only the seconds of that day are counted one by one.
    """
    second = df.where("pickup_ts is not null").select(F.unix_timestamp("pickup_ts").alias("second"))
    days = second.groupBy(F.floor(F.col("second") / 86400).alias("day")).agg(F.count("*").alias("n"))
    of_all = days.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * F.lit(Decimal(str(share))))).cast("long").alias("rank"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    day = days.withColumn("before", before).crossJoin(F.broadcast(of_all)).where("before < rank and before + n >= rank").select(F.col("day").alias("in_day"), "before", "rank")
    seconds = second.join(F.broadcast(day), F.floor(F.col("second") / 86400) == F.col("in_day")).groupBy("second").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rank").alias("rank"))
    reached = F.col("before") + F.sum("n").over(Window.orderBy("second"))
    return seconds.withColumn("reached", reached).agg(F.min(F.when(F.col("reached") >= F.col("rank"), F.col("second"))).alias("cutoff"))


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``part``: train up to the given percentile of pickup time, test after it. The cutoff is one number, joined in the plan."""
    cutoff = cutoff_of(df, share)
    return df.crossJoin(F.broadcast(cutoff)).withColumn("part", F.when(F.unix_timestamp("pickup_ts") <= F.col("cutoff"), "train").otherwise("test"))


def explore_filter(df: DataFrame, borough: str | None = None, weekend: bool | None = None, hours: tuple[int, int] = (0, 23)) -> DataFrame:
    if borough is not None:
        df = df.where(F.col("pu_borough") == borough)
    if weekend is not None:
        df = df.where(F.col("is_weekend") == weekend)
    return df.where(F.col("pickup_hour").between(*hours))


def min_support(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("trips") >= least)


def in_list_filter(df: DataFrame, boroughs: list[str]) -> DataFrame:
    return df.where(F.col("pu_borough").isin(boroughs))


def latest_window(metrics: DataFrame) -> DataFrame:
    newest = metrics.agg(F.max("window_start").alias("newest"))
    return metrics.join(F.broadcast(newest), F.col("window_start") == F.col("newest")).drop("newest")


def well_formed_lines(lines: DataFrame, fields: int = 3, seen: Observation | None = None) -> DataFrame:
    """Lines of exactly ``fields`` tab-separated fields. The job that takes them fills ``seen`` with ``lines`` and ``malformed``, the counts of all lines and of the others."""
    ok = F.coalesce(F.size(F.split("value", "\t", -1)) == fields, F.lit(False))
    if seen is not None:
        lines = lines.observe(seen, F.count("*").alias("lines"), F.count_if(~ok).alias("malformed"))
    return lines.where(ok)


def write_well_formed(lines: DataFrame, path: str, fields: int = 3) -> dict[str, int]:
    """Writes the well-formed lines as text and gives the counters of the same scan."""
    seen = Observation()
    well_formed_lines(lines.select("value"), fields, seen).write.mode("overwrite").text(path)
    return {name: seen.get.get(name, 0) for name in ("lines", "malformed")}
