"""Gold tables: small aggregates of curated trips. Each is one partial and one final hash aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.derive import rounded
from meterline.operators.rules import airport_filter


def trips() -> Column:
    return F.count("*").alias("trips")


def mean(column: str, places: int, name: str) -> Column:
    return rounded(F.avg(column), places).alias(name)


def demand_by_zone_hour(curated: DataFrame) -> DataFrame:
    return curated.groupBy("pu_borough", "pu_zone", "pickup_hour", "is_weekend").agg(trips(), mean("trip_distance", 3, "avg_distance"), mean("duration_min", 2, "avg_duration_min"))


def od_pairs(curated: DataFrame) -> DataFrame:
    keys = ("pu_borough", "pu_zone", "do_borough", "do_zone")
    return curated.groupBy(*keys).agg(trips(), mean("total_amount", 2, "avg_fare"), mean("duration_min", 2, "avg_duration_min"))


def od_matrix(curated: DataFrame, top: int = 200) -> DataFrame:
    """The busiest origin-destination pairs; ties go by zone names."""
    return od_pairs(curated).orderBy(F.desc("trips"), "pu_borough", "pu_zone", "do_borough", "do_zone").limit(top)


def daily_kpis(curated: DataFrame) -> DataFrame:
    return curated.groupBy(F.to_date("pickup_ts").alias("date")).agg(trips(), rounded(F.sum("total_amount"), 2).alias("revenue"), mean("total_amount", 2, "avg_fare"), mean("trip_distance", 3, "avg_distance"), mean("duration_min", 2, "avg_duration_min"))


def _tips() -> list[Column]:
    tipped = F.count_if(F.col("tip_amount") > 0)
    return [trips(), mean("tip_pct", 2, "avg_tip_pct"), mean("fare_amount", 2, "avg_fare"), rounded(100 * tipped / F.count("*"), 2).alias("pct_trips_with_tip")]


def tipping(curated: DataFrame) -> DataFrame:
    return curated.groupBy("pu_borough", "is_card").agg(*_tips())


def tipping_by_label(curated: DataFrame, boroughs: list[str]) -> DataFrame:
    from meterline.functions.derive import payment_label

    kept = curated.where(F.col("pu_borough").isin(boroughs))
    return kept.groupBy("pu_borough", payment_label().alias("payment")).agg(*_tips()).drop("avg_fare")


def speed_by_hour(curated: DataFrame, accuracy: int = 1_000_000) -> DataFrame:
    median = F.percentile_approx("speed_mph", 0.5, accuracy).alias("median_speed")
    return curated.groupBy("pu_borough", "pickup_hour", "is_weekend").agg(trips(), mean("speed_mph", 2, "avg_speed"), median)


def airport_flows(curated: DataFrame, pattern: str) -> DataFrame:
    return airport_filter(curated, pattern).groupBy("pickup_hour", "is_weekend").agg(trips(), mean("total_amount", 2, "avg_fare"), mean("trip_distance", 2, "avg_distance"))


def earnings_by_area_hour(curated: DataFrame) -> DataFrame:
    return curated.groupBy("pu_borough", "pickup_hour", "is_weekend").agg(trips(), mean("total_amount", 2, "avg_fare"), mean("duration_min", 2, "avg_duration_min"))


def route_avg_distance(curated: DataFrame) -> DataFrame:
    return curated.groupBy("pu_borough", "do_borough").agg(mean("trip_distance", 1, "avg_distance"))


def borough_revenue(curated: DataFrame) -> DataFrame:
    return curated.groupBy("pu_borough").agg(trips(), F.sum("total_amount").alias("rev"))


def zone_hour_counts(lines: DataFrame) -> DataFrame:
    """Counts of (borough, zone, hour) from a three-column text table; the map side combines."""
    return lines.groupBy("borough", "zone", "hour").agg(trips())


def zone_hour_demand(curated: DataFrame) -> DataFrame:
    return curated.groupBy("pu_borough", "pu_zone", "pickup_hour", "is_weekend").agg(trips(), mean("total_amount", 2, "avg_fare"))


def borough_zone_rollup(demand: DataFrame, borough: str, top: int = 5) -> DataFrame:
    """Zones of one borough partition by trips, fares weighted by trips."""
    zones = demand.where(F.col("pu_borough") == borough).groupBy("pu_zone")
    fare = rounded(F.sum(F.col("trips") * F.col("avg_fare")) / F.sum("trips"), 2).alias("avg_fare")
    return zones.agg(F.sum("trips").alias("trips"), fare).orderBy(F.desc("trips"), "pu_zone").limit(top)


def year_totals(daily: DataFrame) -> DataFrame:
    total, revenue = F.sum("trips"), F.sum("revenue")
    return daily.agg(F.count("*").alias("days"), total.alias("trips"), rounded(revenue / 1e9, 6).alias("revenue_billions"), rounded(revenue / total, 2).alias("revenue_per_trip"))
