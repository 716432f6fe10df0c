"""Checks that independent ways to one answer agree. Keys may be null, so comparisons are null-safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.derive import rounded


def _full(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    a = left.select(*(F.col(k).alias(f"a_{k}") for k in keys), *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("in_a"))
    b = right.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("in_b"))
    on = None
    for k in keys:
        one = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = one if on is None else on & one
    return a.join(b, on, "full_outer")


def compare_daily_kpis(fresh: DataFrame, stored: DataFrame, top: int = 5) -> DataFrame:
    named = stored.select("date", F.col("trips").alias("stored_trips"), F.col("revenue").alias("stored_revenue"))
    return fresh.select("date", "trips", "revenue").join(named, "date").orderBy("date").limit(top)


def reconcile_daily_kpis(fresh: DataFrame, stored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    both = _full(fresh, stored, ["date"], ["trips", "revenue"])
    money = F.abs(F.col("a_revenue") - F.col("b_revenue")) <= tolerance
    return both.agg(F.count("*").alias("days"), F.count_if(F.col("a_trips") == F.col("b_trips")).alias("equal_trips"), F.count_if(money).alias("equal_revenue"))


def reconcile_demand(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    both = _full(fresh, stored, ["pu_borough", "pu_zone", "pickup_hour", "is_weekend"], ["trips"])
    return both.agg(F.count("*").alias("groups"), F.count_if(F.col("a_trips") == F.col("b_trips")).alias("equal"), F.count_if(F.col("in_b").isNull()).alias("only_fresh"), F.count_if(F.col("in_a").isNull()).alias("only_stored"))


def reconcile_zone_hour_counts(direct: DataFrame, by_text: DataFrame) -> DataFrame:
    both = _full(direct, by_text, ["borough", "zone", "hour"], ["trips"])
    return both.agg(F.count("*").alias("groups"), F.count_if(F.col("a_trips") == F.col("b_trips")).alias("equal"), F.sum("a_trips").alias("direct_trips"), F.sum("b_trips").alias("text_trips"))


def cleaning_summary(raw: DataFrame, curated: DataFrame) -> DataFrame:
    """Two one-row counts side by side."""
    both = raw.agg(F.count("*").alias("raw_rows")).crossJoin(curated.agg(F.count("*").alias("curated_rows")))
    removed = F.col("raw_rows") - F.col("curated_rows")
    return both.withColumns({"removed": removed, "removed_pct": rounded(F.try_divide(100 * removed, F.col("raw_rows")), 3)})
