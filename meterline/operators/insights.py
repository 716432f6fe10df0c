"""Questions asked of the gold tables.

The gold tables are small; these are still plain DataFrame plans. Means are weighted by
trips where the name says so, else they are means of rows, as noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.derive import day_type, earn_per_hour, rounded, route_label

HOURS = list(range(24))


def weighted(value: str, weight: str = "trips") -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def tip_share_weighted(tipping: DataFrame) -> DataFrame:
    """Trip-weighted share of trips with a tip: card and cash, and overall where no payment is known."""
    value, trips = F.col("pct_trips_with_tip") * F.col("trips"), F.col("trips")

    def share(where: Column, name: str) -> Column:
        return rounded(F.try_divide(F.sum(F.when(where, value)), F.sum(F.when(where, trips))), 2).alias(name)

    known = F.count("is_card") > 0
    shares = tipping.agg(share(F.col("is_card"), "card"), share(~F.col("is_card"), "cash"), share(F.lit(True), "all_trips"), known.alias("known"))
    return shares.select("card", "cash", F.when(~F.col("known"), F.col("all_trips")).alias("overall"))


def explore_summary(demand: DataFrame) -> DataFrame:
    return demand.agg(F.sum("trips").alias("trips"), rounded(weighted("avg_distance"), 2).alias("avg_distance"), rounded(weighted("avg_duration_min"), 2).alias("avg_duration_min"))


def trips_per_hour(demand: DataFrame) -> DataFrame:
    return demand.groupBy("pickup_hour").agg(F.sum("trips").alias("trips"))


def overview_totals(daily: DataFrame) -> DataFrame:
    """Totals, and unweighted means of the daily averages."""
    return daily.agg(F.sum("trips").alias("trips"), rounded(F.sum("revenue"), 2).alias("revenue"), rounded(F.avg("avg_fare"), 2).alias("avg_fare"), rounded(F.avg("avg_duration_min"), 2).alias("avg_duration_min"))


def weekend_share(demand: DataFrame) -> DataFrame:
    weekend = F.sum(F.when(F.col("is_weekend"), F.col("trips")).otherwise(0))
    return demand.groupBy("pu_borough").agg(F.sum("trips").alias("trips"), rounded(100 * weekend / F.sum("trips"), 1).alias("weekend_pct"))


def weighted_fare_by_area(pairs: DataFrame) -> DataFrame:
    """Mean fare of pickups in each area, its origin-destination pairs weighted by their trips."""
    return pairs.groupBy("pu_borough").agg(rounded(weighted("avg_fare"), 2).alias("avg_fare"))


def area_profile(demand: DataFrame, pairs: DataFrame) -> DataFrame:
    """Areas with their trips, unweighted mean distance and duration of rows, weekend share and weighted fare."""
    areas = demand.groupBy("pu_borough").agg(rounded(F.avg("avg_distance"), 2).alias("avg_distance"), rounded(F.avg("avg_duration_min"), 2).alias("avg_duration_min"))
    shares, fares = weekend_share(demand), weighted_fare_by_area(pairs)
    for more in (shares, fares):
        named = more.withColumnRenamed("pu_borough", "area")
        areas = areas.join(named, areas["pu_borough"].eqNullSafe(named["area"]), "left").drop("area")
    return areas


def demand_heatmap(demand: DataFrame) -> DataFrame:
    """Trips by area and hour; hours without trips are 0."""
    wide = demand.groupBy("pu_borough").pivot("pickup_hour", HOURS).agg(F.sum("trips"))
    return wide.fillna(0, subset=[str(h) for h in HOURS]).withColumnsRenamed({str(h): f"h{h:02d}" for h in HOURS})


def earnings_heatmap(earnings: DataFrame, least_trips: int = 1000) -> DataFrame:
    """Dollars an hour by area and hour, weekdays and weekends merged by trips; thin cells stay null."""
    cells = earnings.groupBy("pu_borough", "pickup_hour").agg(F.sum("trips").alias("trips"), weighted("avg_fare").alias("avg_fare"), weighted("avg_duration_min").alias("avg_duration_min"))
    cells = cells.where(F.col("trips") >= least_trips).withColumn("per_hour", earn_per_hour())
    return cells.groupBy("pu_borough").pivot("pickup_hour", HOURS).agg(F.first("per_hour")).withColumnsRenamed({str(h): f"h{h:02d}" for h in HOURS})


def area_earnings(earnings: DataFrame) -> DataFrame:
    paid, hours = F.sum(F.col("avg_fare") * F.col("trips")), F.sum(F.col("avg_duration_min") / 60 * F.col("trips"))
    return earnings.groupBy("pu_borough").agg(rounded(F.try_divide(paid, hours), 2).alias("per_hour")).orderBy(F.desc("per_hour"), "pu_borough")


def weekday_weekend_demand(demand: DataFrame) -> DataFrame:
    return demand.groupBy("pu_borough", day_type().alias("day_type")).agg(F.sum("trips").alias("trips"))


def mean_speed_by_hour(speed: DataFrame) -> DataFrame:
    """Unweighted over areas and day types."""
    return speed.groupBy("pickup_hour").agg(rounded(F.avg("avg_speed"), 3).alias("avg_speed"))


def airport_vs_city(airport: DataFrame, daily: DataFrame) -> DataFrame:
    left = airport.agg(F.sum("trips").alias("trips"), F.avg("avg_fare").alias("fare"), rounded(F.avg("avg_distance"), 2).alias("avg_distance"))
    city = daily.agg(F.avg("avg_fare").alias("city_fare"))
    return left.crossJoin(city).select("trips", rounded("fare", 2).alias("avg_fare"), rounded(F.col("fare") - F.col("city_fare"), 2).alias("fare_delta"), "avg_distance")


def airport_trips_per_hour(airport: DataFrame) -> DataFrame:
    return airport.groupBy("pickup_hour").agg(F.sum("trips").alias("trips"))


def key_findings(daily: DataFrame, tipping: DataFrame, speed: DataFrame) -> DataFrame:
    """One fact a row; those of card and other payments where payments are known, else that of all trips."""
    totals, shares = overview_totals(daily), tip_share_weighted(tipping)
    hours = mean_speed_by_hour(speed).agg(F.min_by(F.struct("pickup_hour", "avg_speed"), F.struct("avg_speed", "pickup_hour")).alias("slow"), F.max_by(F.struct("pickup_hour", "avg_speed"), F.struct("avg_speed", -F.col("pickup_hour"))).alias("fast"))
    one = totals.crossJoin(shares).crossJoin(hours)
    facts = {
        "trips": F.format_string("%d trips", "trips"), "revenue": F.format_string("%.2f in revenue", "revenue"), "fare": F.format_string("%.2f average fare", "avg_fare"), "duration": F.format_string("%.2f minutes average duration", "avg_duration_min"),
        "all_tips": F.when(F.col("overall").isNotNull(), F.format_string("%.2f %% of trips have a tip", "overall")), "card_tips": F.when(F.col("card").isNotNull(), F.format_string("%.2f %% of card trips have a tip", "card")), "cash_tips": F.when(F.col("cash").isNotNull(), F.format_string("%.2f %% of other trips have a tip", "cash")),
        "slowest_hour": F.format_string("hour %d is slowest at %.3f mph", "slow.pickup_hour", "slow.avg_speed"), "fastest_hour": F.format_string("hour %d is fastest at %.3f mph", "fast.pickup_hour", "fast.avg_speed"),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("fact"), v.alias("text")) for k, v in facts.items()))).alias("f")).select("f.*").where("text is not null")


def model_findings(evaluation: DataFrame, importance: DataFrame) -> DataFrame:
    """The model's gain over the naive baseline and its strongest input, as facts."""
    best = importance.agg(F.min_by("feature", F.struct(-F.col("importance"), "feature")).alias("feature"))
    baseline = F.col("rmse") / (1 - F.col("improvement_pct") / 100)
    gain = F.format_string("%.0f %% more accurate than the baseline (%.1f minutes of error against %.1f)", "improvement_pct", "rmse", baseline)
    facts = evaluation.crossJoin(best).select(gain.alias("gain"), F.concat(F.lit("strongest predictor: "), F.col("feature")).alias("strongest"))
    return facts.selectExpr("stack(2, 'model_gain', gain, 'strongest_input', strongest) AS (fact, text)")


def comparison_findings(reads: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Facts of measured layouts (layout, bytes_read, shuffle_bytes, seconds): for each named pair, how many times the first's bytes and time the second took."""
    held = {name: F.max(F.when(F.col("layout") == name, F.struct("bytes_read", "shuffle_bytes", "seconds"))).alias(name) for pair in pairs.values() for name in pair}
    one = reads.agg(*held.values())

    def moved(name: str) -> Column:
        return F.col(f"{name}.bytes_read") + F.col(f"{name}.shuffle_bytes")

    facts = [
        F.struct(F.lit(fact).alias("fact"), F.format_string(f"{b} moved %.1f times the bytes of {a} and took %.1f times as long", F.try_divide(moved(b), moved(a)), F.try_divide(F.col(f"{b}.seconds"), F.col(f"{a}.seconds"))).alias("text"))
        for fact, (a, b) in pairs.items()
    ]
    return one.select(F.explode(F.array(*facts)).alias("f")).select("f.*").where("text is not null")


def top_od_pairs(pairs: DataFrame, top: int = 25) -> DataFrame:
    return pairs.orderBy(F.desc("trips"), "pu_borough", "pu_zone", "do_borough", "do_zone").limit(top)


def busiest_weekday_zone_hours(demand: DataFrame, top: int = 10) -> DataFrame:
    return demand.where(~F.col("is_weekend")).select("pu_borough", "pu_zone", "pickup_hour", "trips").orderBy(F.desc("trips"), "pu_zone", "pickup_hour").limit(top)


def best_paying_routes(pairs: DataFrame, top: int = 10) -> DataFrame:
    rows = pairs.where("avg_duration_min > 0").select(route_label().alias("route"), "trips", earn_per_hour().alias("per_hour"))
    return rows.orderBy(F.desc("per_hour"), F.desc("trips"), "route").limit(top)


def cheapest_routes(pairs: DataFrame, least_trips: int = 50, top: int = 10) -> DataFrame:
    rows = pairs.where(F.col("trips") >= least_trips).select(route_label().alias("route"), "trips", "avg_fare")
    return rows.orderBy("avg_fare", F.desc("trips"), "route").limit(top)


def peak_hour(demand: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("pickup_hour", "is_weekend", "trips"), F.struct("trips", -F.col("pickup_hour"), ~F.col("is_weekend"))).alias("best")
    return demand.groupBy("pu_zone").agg(best).select("pu_zone", "best.*")


def peak_day(daily: DataFrame) -> DataFrame:
    return daily.agg(F.max_by(F.struct("date", "trips"), F.struct("trips", F.expr("datediff(date'1970-01-01', date)"))).alias("best")).select("best.*")


def rush_hour_speeds(speed: DataFrame, borough: str) -> DataFrame:
    return speed.where((F.col("pu_borough") == borough) & ~F.col("is_weekend")).select("pickup_hour", "trips", "avg_speed", "median_speed").orderBy("pickup_hour")
