"""Every operator as a query over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions import derive as D
from meterline.operators import enrich, gold, insights, reconcile, rules, serving
from meterline.plans import duration, measure, trees
from meterline.plans.contract import CURATED_SCHEMA
from meterline.sources import fixtures, manifest, trips
from meterline.sources.folders import file_system, scratch, stored_once, stored_or_made
from meterline.streaming import zones as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AIRPORTS = fixtures.AIRPORTS
#: Parameters of the queries, fit to the test tables.
BOROUGHS, BOROUGH, MIN_TRIPS, ROUTE_TRIPS = ["ASIA", "EUROPE"], "ASIA", 100, 50

FIXTURE = """b AS (SELECT l_shipdate AS base_ts, CAST(l_orderkey*31+l_partkey*17+l_suppkey*7+l_linenumber AS BIGINT) AS h, l_quantity AS q, l_suppkey, l_partkey, l_returnflag FROM lineitem),
p AS (SELECT *, (base_ts + to_seconds(h % 86400)) AS p0, CAST(q AS BIGINT)*60+120+h%600 AS dur, h % 150 AS k, CAST(3.0 AS DOUBLE)+q*0.75 AS f FROM b),
raw AS (SELECT h AS trip_id, CAST(year(base_ts) AS INTEGER) AS file_year, CAST(month(base_ts) AS INTEGER) AS file_month,
 CASE WHEN k=0 THEN TIMESTAMP '2098-01-01 00:00:00' ELSE p0 END AS pickup_ts,
 CASE WHEN k=1 THEN (p0 + to_seconds(-300)) WHEN k=4 THEN (p0 + to_seconds(20)) ELSE (p0 + to_seconds(dur)) END AS dropoff_ts,
 CAST(l_suppkey % 27 AS INTEGER) AS PULocationID, CAST(l_partkey % 27 AS INTEGER) AS DOLocationID,
 CAST(CASE WHEN k=2 THEN 250.0 ELSE q/4.0 END AS DOUBLE) AS trip_distance,
 CASE WHEN k=5 THEN CAST(0.0 AS DOUBLE) WHEN k=6 THEN NULL ELSE CAST(1+h%4 AS DOUBLE) END AS passenger_count,
 CASE WHEN k=3 THEN -f ELSE f END AS fare_amount,
 CAST(CASE WHEN l_returnflag='R' THEN 0.0 ELSE f*(h%5)/16.0 END AS DOUBLE) AS tip_amount,
 CAST(CASE WHEN k=3 THEN -f ELSE f+1.25+CASE WHEN l_returnflag='R' THEN 0.0 ELSE f*(h%5)/16.0 END END AS DOUBLE) AS total_amount,
 CASE WHEN l_returnflag='R' THEN 2 ELSE 1 END AS payment_type FROM p),
zones AS (SELECT n_nationkey AS loc_id, r_name AS borough, n_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def r(x: str, n: int) -> str:
    """Half-up rounding of the decimal value."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), {n}) AS DOUBLE)"


DERIVED = f"""{FIXTURE},
d0 AS (SELECT *, CAST(date_diff('second', date_trunc('second', pickup_ts), date_trunc('second', dropoff_ts)) AS BIGINT) AS duration_s FROM raw),
derived AS (SELECT *, {r("duration_s/60.0", 2)} AS duration_min,
 CASE WHEN duration_s > 0 THEN {r("trip_distance/(duration_s/3600.0)", 2)} END AS speed_mph, payment_type = 1 AS is_card,
 CASE WHEN fare_amount > 0 THEN {r("100*tip_amount/fare_amount", 2)} END AS tip_pct,
 CAST(hour(pickup_ts) AS INTEGER) AS pickup_hour, CAST(dayofweek(pickup_ts)+1 AS INTEGER) AS pickup_dow, dayofweek(pickup_ts) IN (0, 6) AS is_weekend FROM d0)"""

KEEP = {
    "out_of_month": "year(pickup_ts) = file_year AND month(pickup_ts) = file_month",
    "dropoff_before_pickup": "dropoff_ts > pickup_ts",
    "duration_out_of_range": "duration_s BETWEEN 60 AND 21600",
    "distance_out_of_range": "trip_distance > 0 AND trip_distance <= 100",
    "negative_money": "fare_amount >= 0 AND total_amount >= 0",
    "impossible_speed": "speed_mph <= 90",
    "zero_passengers": "coalesce(passenger_count, 1) > 0",
}
ALL_KEEP = " AND ".join(f"({k})" for k in KEEP.values())

CURATED = f"""{DERIVED},
clean AS (SELECT * FROM derived WHERE {ALL_KEEP}),
curated AS (SELECT pickup_ts, dropoff_ts, duration_s, duration_min, trip_distance, speed_mph, passenger_count, fare_amount, tip_amount, total_amount, tip_pct, payment_type, is_card, is_weekend, pickup_hour, pickup_dow,
 PULocationID, DOLocationID, a.borough AS pu_borough, a.zone AS pu_zone, c.borough AS do_borough, c.zone AS do_zone, 'yellow' AS dataset, file_year AS year, file_month AS month
 FROM clean LEFT JOIN zones a ON PULocationID = a.loc_id LEFT JOIN zones c ON DOLocationID = c.loc_id)"""


def mean(column: str, n: int) -> str:
    return r(f"avg({column})", n)


TIPS = f"count(*) AS trips, {mean('tip_pct', 2)} AS avg_tip_pct, {mean('fare_amount', 2)} AS avg_fare, {r('100.0*count(CASE WHEN tip_amount > 0 THEN 1 END)/count(*)', 2)} AS pct_trips_with_tip"
GOLD = {
    "demand": f"SELECT pu_borough, pu_zone, pickup_hour, is_weekend, count(*) AS trips, {mean('trip_distance', 3)} AS avg_distance, {mean('duration_min', 2)} AS avg_duration_min FROM curated GROUP BY ALL",
    "pairs": f"SELECT pu_borough, pu_zone, do_borough, do_zone, count(*) AS trips, {mean('total_amount', 2)} AS avg_fare, {mean('duration_min', 2)} AS avg_duration_min FROM curated GROUP BY ALL",
    "daily": f"SELECT CAST(pickup_ts AS DATE) AS date, count(*) AS trips, {r('sum(total_amount)', 2)} AS revenue, {mean('total_amount', 2)} AS avg_fare, {mean('trip_distance', 3)} AS avg_distance, {mean('duration_min', 2)} AS avg_duration_min FROM curated GROUP BY CAST(pickup_ts AS DATE)",
    "tipping": f"SELECT pu_borough, is_card, {TIPS} FROM curated GROUP BY pu_borough, is_card",
    "speed": f"SELECT pu_borough, pickup_hour, is_weekend, count(*) AS trips, {mean('speed_mph', 2)} AS avg_speed, quantile_disc(speed_mph, 0.5) AS median_speed FROM curated GROUP BY pu_borough, pickup_hour, is_weekend",
    "airport": f"SELECT pickup_hour, is_weekend, count(*) AS trips, {mean('total_amount', 2)} AS avg_fare, {mean('trip_distance', 2)} AS avg_distance FROM curated WHERE regexp_matches(pu_zone, '{AIRPORTS}') OR regexp_matches(do_zone, '{AIRPORTS}') GROUP BY pickup_hour, is_weekend",
    "earnings": f"SELECT pu_borough, pickup_hour, is_weekend, count(*) AS trips, {mean('total_amount', 2)} AS avg_fare, {mean('duration_min', 2)} AS avg_duration_min FROM curated GROUP BY pu_borough, pickup_hour, is_weekend",
    "routes": f"SELECT pu_borough, do_borough, {mean('trip_distance', 1)} AS avg_distance FROM curated GROUP BY pu_borough, do_borough",
}
GOLD["demand"] = GOLD["demand"].replace("GROUP BY ALL", "GROUP BY pu_borough, pu_zone, pickup_hour, is_weekend")
GOLD["pairs"] = GOLD["pairs"].replace("GROUP BY ALL", "GROUP BY pu_borough, pu_zone, do_borough, do_zone")
GOLD_OF: dict[str, Callable[[DataFrame], DataFrame]] = {
    "demand": gold.demand_by_zone_hour, "pairs": gold.od_pairs, "daily": gold.daily_kpis, "tipping": gold.tipping, "speed": gold.speed_by_hour, "airport": lambda c: gold.airport_flows(c, AIRPORTS),
    "earnings": gold.earnings_by_area_hour, "routes": gold.route_avg_distance,
}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_raw(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: f(fixtures.raw_trips(s, d)), sql and f"WITH {FIXTURE} {sql}")


def on_derived(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: f(fixtures.derived(s, d)), sql and f"WITH {DERIVED} {sql}")


def on_curated(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: f(fixtures.curated(s, d)), sql and f"WITH {CURATED} {sql}")


def on_gold(name: str, tables: str, f: Callable[..., DataFrame], sql: str | None = None) -> None:
    """``f`` gets the named gold tables, made from one curated scan."""
    names = tables.split()

    def query(s: SparkSession, d: str) -> DataFrame:
        curated = fixtures.curated(s, d)
        return f(*(GOLD_OF[n](curated) for n in names))

    add(name, query, sql and f"WITH {CURATED}, " + ", ".join(f"{n} AS ({GOLD[n]})" for n in names) + f" {sql}")


def day(column: str) -> str:
    return f"CASE WHEN {column} THEN 'weekend' ELSE 'weekday' END"


def w(value: str) -> str:
    return f"sum({value}*trips)/sum(CASE WHEN {value} IS NOT NULL THEN trips END)"


# Projections and derivations
TRIP_KEYS = ["trip_id", "PULocationID", "DOLocationID", "pickup_ts"]


def _timestamps(raw: DataFrame) -> DataFrame:
    named = raw.withColumnsRenamed({"pickup_ts": "tpep_pickup_datetime", "dropoff_ts": "tpep_dropoff_datetime"})
    return D.normalise_timestamps(named, "yellow").select("trip_id", "pickup_ts", "dropoff_ts")


def _fhvhv(raw: DataFrame) -> DataFrame:
    named = raw.select("trip_id", F.col("trip_distance").alias("trip_miles"), F.col("fare_amount").alias("base_passenger_fare"), F.col("tip_amount").alias("tips"), F.when(F.col("passenger_count") > 1, 1.25).alias("tolls"), F.lit(0.5).alias("bcf"))
    return D.normalise_fhvhv(named).select("trip_id", "trip_distance", "fare_amount", "tip_amount", "total_amount")


on_raw("normalise_timestamps", _timestamps, "SELECT trip_id, pickup_ts, dropoff_ts FROM raw")
on_raw("normalise_fhvhv", _fhvhv, """, f AS (SELECT trip_id, trip_distance, coalesce(fare_amount, 0) + CASE WHEN passenger_count > 1 THEN 1.25 ELSE 0 END + 0.5 AS fare_amount, tip_amount FROM raw)
SELECT *, fare_amount + coalesce(tip_amount, 0) AS total_amount FROM f""")
on_raw("fill_contract_columns", lambda t: D.fill_contract_columns(t.select("trip_id", "fare_amount", "payment_type")), "SELECT trip_id, fare_amount, payment_type, CAST(NULL AS DOUBLE) AS trip_distance, CAST(NULL AS DOUBLE) AS tip_amount, CAST(NULL AS DOUBLE) AS total_amount, CAST(NULL AS DOUBLE) AS passenger_count FROM raw")
on_raw("widen_types", lambda t: D.widen_types(t.select("trip_id", F.col("passenger_count").cast("int").alias("passenger_count"), F.col("payment_type").cast("bigint").alias("payment_type"))), "SELECT trip_id, passenger_count, payment_type FROM raw")
for _name, _columns in {
    "duration_s": lambda: {"duration_s": D.duration_s()}, "duration_min": lambda: {"duration_min": D.duration_min()}, "speed_mph": lambda: {"speed_mph": D.speed_mph()}, "pickup_calendar": D.pickup_calendar,
    "is_card": lambda: {"is_card": D.is_card()}, "tip_pct": lambda: {"tip_pct": D.tip_pct()},
}.items():
    on_raw(_name, lambda t, c=_columns: t.select("trip_id", *(v.alias(k) for k, v in c().items())), "")
    SQL[_name] = f"WITH {DERIVED} SELECT trip_id, {'pickup_hour, pickup_dow, is_weekend' if _name == 'pickup_calendar' else _name} FROM derived"
on_derived("derive_trips", lambda t: t.select("trip_id", "duration_s", "duration_min", "speed_mph", "is_card", "tip_pct", "pickup_hour", "pickup_dow", "is_weekend"), "SELECT trip_id, duration_s, duration_min, speed_mph, is_card, tip_pct, pickup_hour, pickup_dow, is_weekend FROM derived")
on_curated("to_contract", lambda c: c, "SELECT * FROM curated")
on_derived("day_type", lambda t: t.select("trip_id", D.day_type().alias("day_type"), D.day_type_of_dow().alias("day_type_of_dow")), f"SELECT trip_id, {day('is_weekend')} AS day_type, {day('is_weekend')} AS day_type_of_dow FROM derived")
on_derived("payment_label", lambda t: t.select("trip_id", D.payment_label().alias("payment")), "SELECT trip_id, CASE WHEN is_card THEN 'card' ELSE 'cash/other' END AS payment FROM derived")
on_gold("route_label", "pairs", lambda p: p.select(D.route_label().alias("route"), "trips"), "SELECT pu_zone || ' → ' || do_zone AS route, trips FROM pairs")
on_gold("earn_per_hour", "pairs", lambda p: p.select("pu_zone", "do_zone", D.earn_per_hour().alias("per_hour")), f"SELECT pu_zone, do_zone, CASE WHEN avg_duration_min > 0 THEN {r('avg_fare/(avg_duration_min/60)', 2)} END AS per_hour FROM pairs")
on_raw("trip_events", lambda t: D.trip_events(t, "yellow", "all").select("key", "value"))

# Rules
for _name in KEEP:
    on_derived(f"rule_{_name}", lambda t, n=_name: t.where(rules.rules()[n]).select("trip_id", "PULocationID", "DOLocationID"), f"SELECT trip_id, PULocationID, DOLocationID FROM derived WHERE {KEEP[_name]}")
on_derived("clean_trips", lambda t: rules.clean_trips(t).select("trip_id", "pickup_ts", "dropoff_ts", "speed_mph", "total_amount"), f"SELECT trip_id, pickup_ts, dropoff_ts, speed_mph, total_amount FROM derived WHERE {ALL_KEEP}")
on_derived("quality_report", rules.quality_report, " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) - count(CASE WHEN {k} THEN 1 END) AS bad_rows, {r(f'100.0*(count(*) - count(CASE WHEN {k} THEN 1 END))/count(*)', 3)} AS pct FROM derived" for n, k in KEEP.items()))
on_derived("curate_stats", rules.curate_stats, f"""SELECT file_year, file_month, count(*) AS rows_in, count(CASE WHEN {ALL_KEEP} THEN 1 END) AS rows_out, count(*) - count(CASE WHEN {ALL_KEEP} THEN 1 END) AS removed,
 {r(f'100.0*(count(*) - count(CASE WHEN {ALL_KEEP} THEN 1 END))/count(*)', 3)} AS removed_pct FROM derived GROUP BY file_year, file_month""")


def _partition_filter(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "curated")
    trips.write_curated(fixtures.curated(s, d), path)
    return rules.partition_filter(trips.scan_curated(s, path), 1995, 3).groupBy("pu_borough").agg(F.count("*").alias("trips"))


add("partition_filter", _partition_filter, f"WITH {CURATED} SELECT pu_borough, count(*) AS trips FROM curated WHERE year = 1995 AND month = 3 GROUP BY pu_borough")
on_curated("airport_filter", lambda c: rules.airport_filter(c, AIRPORTS).groupBy("pu_zone", "do_zone").agg(F.count("*").alias("trips")), f"SELECT pu_zone, do_zone, count(*) AS trips FROM curated WHERE regexp_matches(pu_zone, '{AIRPORTS}') OR regexp_matches(do_zone, '{AIRPORTS}') GROUP BY pu_zone, do_zone")
MODEL_COLUMNS = ["trip_distance", "pickup_hour", "pickup_dow", "passenger_count", "pu_borough", "do_borough", "duration_min"]
on_curated("feature_rows", lambda c: rules.feature_rows(c, MODEL_COLUMNS).select(*MODEL_COLUMNS), f"SELECT {', '.join(MODEL_COLUMNS)} FROM curated WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_COLUMNS)}")
on_curated("sample_trips", lambda c: rules.sample_trips(c, 0.1).select("pickup_ts", "dropoff_ts", "PULocationID", "DOLocationID", "total_amount"),
           f"SELECT pickup_ts, dropoff_ts, PULocationID, DOLocationID, total_amount FROM curated WHERE substr(md5(concat_ws('|', '42', {', '.join(f'CAST(CAST(epoch(date_trunc(\'second\', {c})) AS BIGINT) AS VARCHAR)' for c in ('pickup_ts', 'dropoff_ts'))}, coalesce(CAST(PULocationID AS VARCHAR), ''), coalesce(CAST(DOLocationID AS VARCHAR), ''))), 1, 8) < '{int(0.1 * 2**32):08x}'")
CUTOFF = "(SELECT quantile_disc(epoch(date_trunc('second', pickup_ts)), 0.8) FROM curated)"
on_curated("time_split", lambda c: rules.time_split(c).groupBy("part").agg(F.count("*").alias("n"), F.max("pickup_ts").alias("latest")), f"SELECT CASE WHEN epoch(date_trunc('second', pickup_ts)) <= {CUTOFF} THEN 'train' ELSE 'test' END AS part, count(*) AS n, max(pickup_ts) AS latest FROM curated GROUP BY 1")
EXPLORE = f"SELECT * FROM demand WHERE pu_borough = '{BOROUGH}' AND is_weekend = false AND pickup_hour BETWEEN 7 AND 19"
on_gold("explore_filter", "demand", lambda t: rules.explore_filter(t, BOROUGH, False, (7, 19)), EXPLORE)
on_gold("min_support", "earnings", lambda t: rules.min_support(t, MIN_TRIPS), f"SELECT * FROM earnings WHERE trips >= {MIN_TRIPS}")
on_gold("in_list_filter", "tipping", lambda t: rules.in_list_filter(t, BOROUGHS), f"SELECT * FROM tipping WHERE pu_borough IN ({', '.join(map(repr, BOROUGHS))})")

# Joins
ZONED = "trip_id, pu_borough, pu_zone, do_borough, do_zone"
ZONED_SQL = "SELECT trip_id, a.borough AS pu_borough, a.zone AS pu_zone, c.borough AS do_borough, c.zone AS do_zone FROM raw LEFT JOIN zones a ON PULocationID = a.loc_id LEFT JOIN zones c ON DOLocationID = c.loc_id"
add("enrich_zones", lambda s, d: enrich.enrich_zones(fixtures.raw_trips(s, d), fixtures.zones(s, d)).select(*ZONED.split(", ")), f"WITH {FIXTURE} {ZONED_SQL}")
add("enrich_zones_sortmerge", lambda s, d: enrich.enrich_zones_sortmerge(fixtures.raw_trips(s, d), fixtures.zones(s, d)).select(*ZONED.split(", ")), f"WITH {FIXTURE} {ZONED_SQL}")
add("trips_per_borough", lambda s, d: enrich.trips_per_borough(fixtures.raw_trips(s, d).select(F.when(F.col("PULocationID") % 5 == 0, "n/a").otherwise(F.col("PULocationID").cast("string")).alias("location")), fixtures.zones(s, d)), f"WITH {FIXTURE} SELECT borough, count(*) AS trips FROM raw JOIN zones ON PULocationID = loc_id WHERE PULocationID % 5 <> 0 GROUP BY borough")


def _stored_daily(curated: DataFrame) -> DataFrame:
    """The daily table as if stored earlier: without its trips of one month's start."""
    return gold.daily_kpis(curated.where("not (year = 1995 and month = 3 and pickup_hour = 0)"))


STORED = f"stored AS ({GOLD['daily'].replace('FROM curated', 'FROM curated WHERE NOT (year = 1995 AND month = 3 AND pickup_hour = 0)')})"
on_curated("compare_daily_kpis", lambda c: reconcile.compare_daily_kpis(gold.daily_kpis(c), _stored_daily(c)), f", daily AS ({GOLD['daily']}), {STORED} SELECT daily.date, daily.trips, daily.revenue, stored.trips AS stored_trips, stored.revenue AS stored_revenue FROM daily JOIN stored ON daily.date = stored.date ORDER BY daily.date LIMIT 5")
on_curated("reconcile_daily_kpis", lambda c: reconcile.reconcile_daily_kpis(gold.daily_kpis(c), _stored_daily(c)), f", daily AS ({GOLD['daily']}), {STORED} SELECT count(*) AS days, count(CASE WHEN a.trips = b.trips THEN 1 END) AS equal_trips, count(CASE WHEN abs(a.revenue - b.revenue) <= 0.01 THEN 1 END) AS equal_revenue FROM daily a FULL OUTER JOIN stored b ON a.date = b.date")
EARLIER = f"earlier AS ({GOLD['demand'].replace('FROM curated', 'FROM curated WHERE NOT (pickup_hour = 5 AND is_weekend)')})"
SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ("pu_borough", "pu_zone", "pickup_hour", "is_weekend"))
on_curated("reconcile_demand", lambda c: reconcile.reconcile_demand(gold.demand_by_zone_hour(c), gold.demand_by_zone_hour(c.where("not (pickup_hour = 5 and is_weekend)"))), f""", demand AS ({GOLD['demand']}), {EARLIER}
SELECT count(*) AS groups, count(CASE WHEN a.trips = b.trips THEN 1 END) AS equal, count(CASE WHEN b.trips IS NULL THEN 1 END) AS only_fresh, count(CASE WHEN a.trips IS NULL THEN 1 END) AS only_stored FROM demand a FULL OUTER JOIN earlier b ON {SAME}""")


def _by_text(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Curated trips, and the counts of their text extract."""
    path, curated = scratch(s, "lines"), fixtures.curated(s, d)
    trips.export_tsv(curated, path)
    return curated, gold.zone_hour_counts(trips.scan_tsv(s, path))


LINES = "SELECT pu_borough AS borough, pu_zone AS zone, pickup_hour AS hour, count(*) AS trips FROM curated GROUP BY pu_borough, pu_zone, pickup_hour"


def _reconcile_text(s: SparkSession, d: str) -> DataFrame:
    curated, counted = _by_text(s, d)
    direct = curated.groupBy(F.col("pu_borough").alias("borough"), F.col("pu_zone").alias("zone"), F.col("pickup_hour").alias("hour")).agg(gold.trips())
    return reconcile.reconcile_zone_hour_counts(direct, counted)


add("reconcile_zone_hour_counts", _reconcile_text, f"WITH {CURATED}, c AS ({LINES}) SELECT count(*) AS groups, count(*) AS equal, CAST(sum(trips) AS BIGINT) AS direct_trips, CAST(sum(trips) AS BIGINT) AS text_trips FROM c")
add("zone_hour_counts", lambda s, d: _by_text(s, d)[1], f"WITH {CURATED} {LINES}")
add("cleaning_summary", lambda s, d: reconcile.cleaning_summary(fixtures.raw_trips(s, d), rules.clean_trips(fixtures.derived(s, d))), f"WITH {CURATED}, n AS (SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM clean) AS curated_rows) SELECT raw_rows, curated_rows, raw_rows - curated_rows AS removed, {r('100.0*(raw_rows - curated_rows)/raw_rows', 3)} AS removed_pct FROM n")
on_gold("area_profile", "demand pairs", insights.area_profile, f""", a AS (SELECT pu_borough, {mean('avg_distance', 2)} AS avg_distance, {mean('avg_duration_min', 2)} AS avg_duration_min, CAST(sum(trips) AS BIGINT) AS trips, {r('100.0*sum(CASE WHEN is_weekend THEN trips ELSE 0 END)/sum(trips)', 1)} AS weekend_pct FROM demand GROUP BY pu_borough),
f AS (SELECT pu_borough AS area, {r(w('avg_fare'), 2)} AS avg_fare FROM pairs GROUP BY pu_borough) SELECT pu_borough, avg_distance, avg_duration_min, trips, weekend_pct, avg_fare FROM a LEFT JOIN f ON pu_borough IS NOT DISTINCT FROM area""")

# Gold tables
on_curated("demand_by_zone_hour", gold.demand_by_zone_hour, GOLD["demand"])
on_curated("od_matrix", gold.od_matrix, f"{GOLD['pairs']} ORDER BY trips DESC, pu_borough NULLS FIRST, pu_zone NULLS FIRST, do_borough NULLS FIRST, do_zone NULLS FIRST LIMIT 200")
on_curated("daily_kpis", gold.daily_kpis, GOLD["daily"])
on_curated("tipping", gold.tipping, GOLD["tipping"])
on_curated("speed_by_hour", gold.speed_by_hour, GOLD["speed"])
on_curated("airport_flows", lambda c: gold.airport_flows(c, AIRPORTS), GOLD["airport"])
on_curated("earnings_by_area_hour", gold.earnings_by_area_hour, GOLD["earnings"])
on_curated("route_avg_distance", gold.route_avg_distance, GOLD["routes"])
on_curated("borough_revenue", gold.borough_revenue, "SELECT pu_borough, count(*) AS trips, sum(total_amount) AS rev FROM curated GROUP BY pu_borough")
ZONE_HOUR = f"SELECT pu_borough, pu_zone, pickup_hour, is_weekend, count(*) AS trips, {mean('total_amount', 2)} AS avg_fare FROM curated GROUP BY pu_borough, pu_zone, pickup_hour, is_weekend"
on_curated("zone_hour_demand", gold.zone_hour_demand, ZONE_HOUR)
on_curated("borough_zone_rollup", lambda c: gold.borough_zone_rollup(gold.zone_hour_demand(c), BOROUGH), f", z AS ({ZONE_HOUR}) SELECT pu_zone, CAST(sum(trips) AS BIGINT) AS trips, {r('sum(trips*avg_fare)/sum(trips)', 2)} AS avg_fare FROM z WHERE pu_borough = '{BOROUGH}' GROUP BY pu_zone ORDER BY trips DESC, pu_zone LIMIT 5")
on_gold("year_totals", "daily", gold.year_totals, f"SELECT count(*) AS days, CAST(sum(trips) AS BIGINT) AS trips, {r('sum(revenue)/1e9', 6)} AS revenue_billions, {r('sum(revenue)/sum(trips)', 2)} AS revenue_per_trip FROM daily")
on_curated("tipping_by_label", lambda c: gold.tipping_by_label(c, BOROUGHS), f"SELECT pu_borough, CASE WHEN is_card THEN 'card' ELSE 'cash/other' END AS payment, count(*) AS trips, {mean('tip_pct', 2)} AS avg_tip_pct, {r('100.0*count(CASE WHEN tip_amount > 0 THEN 1 END)/count(*)', 2)} AS pct_trips_with_tip FROM curated WHERE pu_borough IN ({', '.join(map(repr, BOROUGHS))}) GROUP BY 1, 2")

# Insights
def _share(where: str) -> str:
    return r(f"sum(CASE WHEN {where} THEN pct_trips_with_tip*trips END)/sum(CASE WHEN {where} THEN trips END)", 2)


SHARES = f"SELECT {_share('is_card')} AS card, {_share('NOT is_card')} AS cash, CASE WHEN count(is_card) = 0 THEN {_share('true')} END AS overall FROM tipping"
on_gold("tip_share_weighted", "tipping", insights.tip_share_weighted, SHARES)
on_gold("tip_share_unknown", "tipping", lambda t: insights.tip_share_weighted(t.withColumn("is_card", F.lit(None).cast("boolean"))), f", unknown AS (SELECT * FROM tipping) SELECT CAST(NULL AS DOUBLE) AS card, CAST(NULL AS DOUBLE) AS cash, {r('sum(pct_trips_with_tip*trips)/sum(trips)', 2)} AS overall FROM unknown")
on_gold("explore_summary", "demand", lambda t: insights.explore_summary(rules.explore_filter(t, BOROUGH, False, (7, 19))), f", e AS ({EXPLORE}) SELECT CAST(sum(trips) AS BIGINT) AS trips, {r(w('avg_distance'), 2)} AS avg_distance, {r(w('avg_duration_min'), 2)} AS avg_duration_min FROM e")
on_gold("explore_trips_per_hour", "demand", lambda t: insights.trips_per_hour(rules.explore_filter(t, BOROUGH, False, (7, 19))), f", e AS ({EXPLORE}) SELECT pickup_hour, CAST(sum(trips) AS BIGINT) AS trips FROM e GROUP BY pickup_hour")
TOTALS = f"SELECT CAST(sum(trips) AS BIGINT) AS trips, {r('sum(revenue)', 2)} AS revenue, {mean('avg_fare', 2)} AS avg_fare, {mean('avg_duration_min', 2)} AS avg_duration_min FROM daily"
on_gold("overview_totals", "daily", insights.overview_totals, TOTALS)
on_gold("weekend_share", "demand", insights.weekend_share, f"SELECT pu_borough, CAST(sum(trips) AS BIGINT) AS trips, {r('100.0*sum(CASE WHEN is_weekend THEN trips ELSE 0 END)/sum(trips)', 1)} AS weekend_pct FROM demand GROUP BY pu_borough")
on_gold("weighted_fare_by_area", "pairs", insights.weighted_fare_by_area, f"SELECT pu_borough, {r(w('avg_fare'), 2)} AS avg_fare FROM pairs GROUP BY pu_borough")
on_gold("demand_heatmap", "demand", insights.demand_heatmap, "SELECT pu_borough, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN pickup_hour = {h} THEN trips END), 0) AS BIGINT) AS h{h:02d}" for h in range(24)) + " FROM demand GROUP BY pu_borough")
CELLS = f"cells AS (SELECT pu_borough, pickup_hour, sum(trips) AS trips, {w('avg_fare')} AS fare, {w('avg_duration_min')} AS minutes FROM earnings GROUP BY pu_borough, pickup_hour)"
on_gold("earnings_heatmap", "earnings", lambda t: insights.earnings_heatmap(t, MIN_TRIPS), f", {CELLS} SELECT pu_borough, " + ", ".join(f"max(CASE WHEN pickup_hour = {h} THEN {r('fare/(minutes/60)', 2)} END) AS h{h:02d}" for h in range(24)) + f" FROM cells WHERE trips >= {MIN_TRIPS} GROUP BY pu_borough")
on_gold("area_earnings", "earnings", insights.area_earnings, f"SELECT pu_borough, {r('sum(avg_fare*trips)/sum(avg_duration_min/60*trips)', 2)} AS per_hour FROM earnings GROUP BY pu_borough")
on_gold("weekday_weekend_demand", "demand", insights.weekday_weekend_demand, f"SELECT pu_borough, {day('is_weekend')} AS day_type, CAST(sum(trips) AS BIGINT) AS trips FROM demand GROUP BY 1, 2")
SPEEDS = f"SELECT pickup_hour, {mean('avg_speed', 3)} AS avg_speed FROM speed GROUP BY pickup_hour"
on_gold("mean_speed_by_hour", "speed", insights.mean_speed_by_hour, SPEEDS)
on_gold("airport_vs_city", "airport daily", insights.airport_vs_city, f"SELECT CAST(sum(trips) AS BIGINT) AS trips, {mean('avg_fare', 2)} AS avg_fare, {r('avg(avg_fare) - (SELECT avg(avg_fare) FROM daily)', 2)} AS fare_delta, {mean('avg_distance', 2)} AS avg_distance FROM airport")
on_gold("airport_trips_per_hour", "airport", insights.airport_trips_per_hour, "SELECT pickup_hour, CAST(sum(trips) AS BIGINT) AS trips FROM airport GROUP BY pickup_hour")
on_gold("key_findings", "daily tipping speed", insights.key_findings, f""", t AS ({TOTALS}), h AS ({SHARES}), v AS ({SPEEDS}), slow AS (SELECT * FROM v ORDER BY avg_speed, pickup_hour LIMIT 1), fast AS (SELECT * FROM v ORDER BY avg_speed DESC, pickup_hour LIMIT 1)
SELECT 'trips' AS fact, printf('%d trips', trips) AS text FROM t UNION ALL SELECT 'revenue', printf('%.2f in revenue', revenue) FROM t UNION ALL SELECT 'fare', printf('%.2f average fare', avg_fare) FROM t UNION ALL SELECT 'duration', printf('%.2f minutes average duration', avg_duration_min) FROM t
UNION ALL SELECT 'card_tips', printf('%.2f %% of card trips have a tip', card) FROM h UNION ALL SELECT 'cash_tips', printf('%.2f %% of other trips have a tip', cash) FROM h
UNION ALL SELECT 'slowest_hour', printf('hour %d is slowest at %.3f mph', pickup_hour, avg_speed) FROM slow UNION ALL SELECT 'fastest_hour', printf('hour %d is fastest at %.3f mph', pickup_hour, avg_speed) FROM fast""")
on_gold("key_findings_unknown", "daily tipping speed", lambda d, t, s: insights.key_findings(d, t.withColumn("is_card", F.lit(None).cast("boolean")), s).where("fact like '%tips'"), f"SELECT 'all_tips' AS fact, printf('%.2f %% of trips have a tip', {r('sum(pct_trips_with_tip*trips)/sum(trips)', 2)}) AS text FROM tipping")
on_gold("top_od_pairs", "pairs", insights.top_od_pairs, "SELECT * FROM pairs ORDER BY trips DESC, pu_borough NULLS FIRST, pu_zone NULLS FIRST, do_borough NULLS FIRST, do_zone NULLS FIRST LIMIT 25")
on_gold("busiest_weekday_zone_hours", "demand", insights.busiest_weekday_zone_hours, "SELECT pu_borough, pu_zone, pickup_hour, trips FROM demand WHERE NOT is_weekend ORDER BY trips DESC, pu_zone NULLS FIRST, pickup_hour LIMIT 10")
RATE = r("avg_fare/(avg_duration_min/60)", 2)
on_gold("best_paying_routes", "pairs", insights.best_paying_routes, f"SELECT pu_zone || ' → ' || do_zone AS route, trips, {RATE} AS per_hour FROM pairs WHERE avg_duration_min > 0 ORDER BY per_hour DESC, trips DESC, route NULLS FIRST LIMIT 10")
on_gold("cheapest_routes", "pairs", lambda p: insights.cheapest_routes(p, ROUTE_TRIPS), f"SELECT pu_zone || ' → ' || do_zone AS route, trips, avg_fare FROM pairs WHERE trips >= {ROUTE_TRIPS} ORDER BY avg_fare, trips DESC, route NULLS FIRST LIMIT 10")
on_gold("peak_hour", "demand", insights.peak_hour, ", o AS (SELECT *, row_number() OVER (PARTITION BY pu_zone ORDER BY trips DESC, pickup_hour, is_weekend) AS n FROM demand) SELECT pu_zone, pickup_hour, is_weekend, trips FROM o WHERE n = 1")
on_gold("peak_day", "daily", insights.peak_day, "SELECT date, trips FROM daily ORDER BY trips DESC, date LIMIT 1")
on_gold("rush_hour_speeds", "speed", lambda t: insights.rush_hour_speeds(t, BOROUGH), f"SELECT pickup_hour, trips, avg_speed, median_speed FROM speed WHERE pu_borough = '{BOROUGH}' AND NOT is_weekend ORDER BY pickup_hour")

# Serving tables
DEMAND_KEY = f"concat_ws('#', pu_zone, {day('is_weekend')}, lpad(CAST(pickup_hour AS VARCHAR), 2, '0'))"
DEMAND_ROWS = f"rows AS (SELECT {DEMAND_KEY} AS row_key, trips, avg_distance, avg_duration_min, pu_borough AS borough, pu_zone AS zone, {day('is_weekend')} AS daytype, pickup_hour AS hour FROM demand WHERE pu_zone IS NOT NULL)"
DAILY_ROWS = "rows AS (SELECT strftime(date, '%Y-%m-%d') AS row_key, trips, revenue, avg_fare, avg_distance, avg_duration_min FROM daily)"


def served(rows: Callable[[DataFrame], DataFrame], f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Writes the serving table, then asks it."""

    def ask(table: DataFrame) -> DataFrame:
        path = scratch(table.sparkSession, "serving")
        serving.write_serving_table(rows(table), path)
        return f(table.sparkSession.read.parquet(path))

    return ask


on_gold("demand_key", "demand", serving.demand_rows, f", {DEMAND_ROWS} SELECT * FROM rows")
on_gold("daily_key", "daily", serving.daily_rows, f", {DAILY_ROWS} SELECT * FROM rows")
on_curated("duration_key", lambda c: c.where("pu_borough is not null and do_borough is not null").select(serving.duration_key(F.col("is_weekend")).alias("row_key"), "duration_min"), f"SELECT concat_ws('#', pu_borough, do_borough, {day('is_weekend')}, lpad(CAST(pickup_hour AS VARCHAR), 2, '0'), lpad(printf('%.1f', CAST(round(CAST(trip_distance AS DECIMAL(18,6)), 1) AS DOUBLE)), 4, '0')) AS row_key, duration_min FROM curated WHERE pu_borough IS NOT NULL AND do_borough IS NOT NULL")
# every seventh trip's zone has the separator in its name
on_derived("validate_key_parts", lambda t: serving.invalid_key_parts(t.select("trip_id", "trip_distance", "pickup_hour", F.when(F.col("trip_id") % 7 == 0, "A#B").otherwise("A").alias("zone")), ["zone"], "pickup_hour", "trip_distance"),
           "SELECT trip_id, trip_distance, pickup_hour, CASE WHEN trip_id % 7 = 0 THEN 'A#B' ELSE 'A' END AS zone, CASE WHEN trip_id % 7 = 0 THEN 'zone' ELSE 'miles' END AS reason FROM derived WHERE trip_id % 7 = 0 OR trip_distance < 0 OR trip_distance >= 100")
# distances are without a value in a part of the rows, which then have no such cell
on_gold("serving_cells", "demand", lambda d: serving.cells(serving.demand_rows(d.withColumn("avg_distance", F.when(F.col("pickup_hour") != 3, F.col("avg_distance")))), serving.FAMILIES).where("cell <> 'm:avg_duration_min'"), f""", {DEMAND_ROWS}
SELECT row_key, 'm:trips' AS cell, CAST(trips AS VARCHAR) AS value FROM rows UNION ALL SELECT row_key, 'm:avg_distance', CAST(avg_distance AS VARCHAR) FROM rows WHERE hour <> 3 UNION ALL SELECT row_key, 'z:borough', borough FROM rows
UNION ALL SELECT row_key, 'z:zone', zone FROM rows UNION ALL SELECT row_key, 'z:daytype', daytype FROM rows UNION ALL SELECT row_key, 'z:hour', CAST(hour AS VARCHAR) FROM rows""")
on_gold("write_serving_table", "demand", served(serving.demand_rows, lambda t: t), f", {DEMAND_ROWS} SELECT * FROM rows")
on_gold("get_row", "demand", served(serving.demand_rows, lambda t: serving.get_row(t, "NATION_3#weekday#08", ["trips"])), f", {DEMAND_ROWS} SELECT row_key, trips FROM rows WHERE row_key = 'NATION_3#weekday#08'")
on_gold("scan_prefix", "demand", served(serving.demand_rows, lambda t: serving.scan_prefix(t, "NATION_3#weekend#")), f", {DEMAND_ROWS} SELECT * FROM rows WHERE starts_with(row_key, 'NATION_3#weekend#')")
on_gold("scan_range", "daily", served(serving.daily_rows, lambda t: serving.scan_range(t, "1995-03-01", "1995-04-01")), f", {DAILY_ROWS} SELECT * FROM rows WHERE row_key >= '1995-03-01' AND row_key < '1995-04-01'")
on_gold("count_rows", "demand", served(serving.demand_rows, serving.count_rows), f", {DEMAND_ROWS} SELECT count(*) AS n FROM rows")
on_gold("month_summary", "daily", served(serving.daily_rows, lambda t: serving.month_summary(t, "1995-12")), f", {DAILY_ROWS}, m AS (SELECT * FROM rows WHERE row_key >= '1995-12' AND row_key < '1996-01') SELECT count(*) AS days, CAST(sum(trips) AS BIGINT) AS trips, sum(revenue) AS revenue, (SELECT row_key FROM m ORDER BY trips DESC, row_key LIMIT 1) AS busiest_day FROM m")


# Sources and sinks: each writes what it reads to the shared folder
def _bronze_files(s: SparkSession, d: str) -> tuple[str, list[tuple[int, int]]]:
    """All raw trips as files of their months: the folder and the months."""
    root = scratch(s, "bronze")
    return root, trips.write_bronze(fixtures.raw_trips(s, d), root, "yellow")


def _bronze(s: SparkSession, d: str) -> DataFrame:
    """One more month is asked for and missing."""
    root, there = _bronze_files(s, d)
    return trips.scan_bronze(s, root, "yellow", [*there, (2050, 1)])


def _month_sums(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("file_year", "file_month").agg(F.count("*").alias("n"), F.sum("trip_distance").alias("miles"))


BRONZE_SQL = f"WITH {FIXTURE} SELECT file_year, file_month, count(*) AS n, sum(trip_distance) AS miles FROM raw GROUP BY file_year, file_month"
add("scan_bronze", lambda s, d: _month_sums(_bronze(s, d)), BRONZE_SQL)

#: How months store their columns, by the number of the month: ids as 64-bit numbers and passengers as whole ones, no tips, and a name in small letters with times without a zone.
LAYOUTS: list[Callable[[DataFrame], DataFrame]] = [
    lambda t: t,
    lambda t: t.withColumns({"PULocationID": F.col("PULocationID").cast("long"), "DOLocationID": F.col("DOLocationID").cast("long"), "passenger_count": F.col("passenger_count").cast("long")}),
    lambda t: t.drop("tip_amount"),
    lambda t: t.withColumnRenamed("PULocationID", "pulocationid").withColumn("dropoff_ts", F.col("dropoff_ts").cast("timestamp_ntz")),
]


def _unlike_months(s: SparkSession, d: str) -> DataFrame:
    root, raw = scratch(s, "bronze"), fixtures.raw_trips(s, d)
    number = (F.col("file_year") * 12 + F.col("file_month")) % len(LAYOUTS)
    there = [m for k, layout in enumerate(LAYOUTS) for m in trips.write_bronze(layout(raw.where(number == k)), root, "yellow")]
    return D.widen_types(trips.scan_bronze(s, root, "yellow", sorted(there)))


def _unlike_sums(bronze: DataFrame) -> DataFrame:
    sums = [F.sum("PULocationID").alias("pickups"), F.sum("passenger_count").alias("passengers"), F.sum("tip_amount").alias("tips"), F.max("dropoff_ts").alias("latest"), F.max(F.typeof("PULocationID")).alias("id_type")]
    return bronze.groupBy("file_year", "file_month").agg(F.count("*").alias("n"), *sums)


UNLIKE_SQL = f"""WITH {FIXTURE} SELECT file_year, file_month, count(*) AS n, CAST(sum(PULocationID) AS BIGINT) AS pickups, sum(passenger_count) AS passengers, CASE WHEN (file_year*12 + file_month) % {len(LAYOUTS)} <> 2 THEN sum(tip_amount) END AS tips,
 max(dropoff_ts) AS latest, 'int' AS id_type FROM raw GROUP BY file_year, file_month"""
add("scan_bronze_all_months", lambda s, d: _unlike_sums(_unlike_months(s, d)), UNLIKE_SQL)
add("curate_unlike_months", lambda s, d: by_month(fixtures.curate(s, d, _unlike_months(s, d).fillna(0.0, ["tip_amount"]))), f"WITH {CURATED} SELECT year, month, count(*) AS n, sum(total_amount) AS total FROM curated GROUP BY year, month")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    root, there = _bronze_files(s, d)
    return manifest.bronze_manifest(manifest.present_files(s, root, "yellow"), trips.scan_bronze(s, root, "yellow", there))


def _refreshed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Curates all months, then, after one month's trips came twice and one month's files went, what had changed: the changes, the curated layer and the manifest."""
    root, _ = _bronze_files(s, d)
    layer, told = scratch(s, "curated"), scratch(s, "manifest")
    curate = lambda raw: fixtures.curate(s, d, raw)
    manifest.refresh(s, root, "yellow", layer, told, curate)
    month = fixtures.raw_trips(s, d).where("file_year = 1995 and file_month = 3")
    trips.write_bronze(month.unionByName(month), root, "yellow")
    fs, path = file_system(s, root)
    fs.delete(path(f"{root}/yellow_tripdata_1996-01.parquet"), True)
    found = manifest.refresh(s, root, "yellow", layer, told, curate)
    return found, trips.scan_curated(s, layer), manifest.stored_manifest(s, told)


add("bronze_manifest", lambda s, d: _manifest(s, d).select("file", "bytes", "rows"))
add("bronze_manifest_rows", lambda s, d: _manifest(s, d).groupBy("year", "month").agg(F.sum("rows").alias("rows")), f"WITH {FIXTURE} SELECT file_year AS year, file_month AS month, count(*) AS rows FROM raw GROUP BY file_year, file_month")
AGAIN = "CASE WHEN {0}year = 1995 AND {0}month = 3 THEN 2 ELSE 1 END * "
add("changed_months", lambda s, d: _refreshed(s, d)[0], "SELECT CAST(1995 AS INTEGER) AS year, CAST(3 AS INTEGER) AS month, 'changed' AS change UNION ALL SELECT 1996, 1, 'gone'")
add("refresh_curated", lambda s, d: by_month(_refreshed(s, d)[1]), f"WITH {CURATED} SELECT year, month, {AGAIN.format('')} count(*) AS n, {AGAIN.format('')} sum(total_amount) AS total FROM curated WHERE NOT (year = 1996 AND month = 1) GROUP BY year, month")
add("refreshed_manifest", lambda s, d: _refreshed(s, d)[2].groupBy("year", "month").agg(F.sum("rows").alias("rows")), f"WITH {FIXTURE} SELECT file_year AS year, file_month AS month, {AGAIN.format('file_')} count(*) AS rows FROM raw WHERE NOT (file_year = 1996 AND file_month = 1) GROUP BY file_year, file_month")
add("gold_freshness", lambda s, d: manifest.layer_freshness(manifest.present_files(s, _bronze_files(s, d)[0], "yellow")))


def round_trip(name: str, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], rows: Callable[[SparkSession, str], DataFrame]) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        path = scratch(s, name)
        write(rows(s, d), path)
        return read(s, path)

    return query


def parquet(s: SparkSession, path: str) -> DataFrame:
    return s.read.parquet(path)


BY_MONTH = "SELECT year, month, count(*) AS n, sum(total_amount) AS total FROM curated GROUP BY year, month"


def by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("total_amount").alias("total"))


add("scan_curated", round_trip("curated", trips.write_curated, lambda s, p: by_month(trips.scan_curated(s, p)), fixtures.curated), f"WITH {CURATED} {BY_MONTH}")


def _overwrite_month(curated: DataFrame, path: str) -> None:
    """Writes all, then one month again with doubled rows: only that partition changes."""
    trips.write_curated(curated, path)
    month = curated.where("year = 1995 and month = 3")
    trips.write_curated(month.unionByName(month), path)


add("write_curated", round_trip("curated", _overwrite_month, lambda s, p: by_month(trips.scan_curated(s, p)), fixtures.curated), f"WITH {CURATED}, m AS ({BY_MONTH}) SELECT year, month, CASE WHEN year = 1995 AND month = 3 THEN 2*n ELSE n END AS n, CASE WHEN year = 1995 AND month = 3 THEN 2*total ELSE total END AS total FROM m")


def declared(ask: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Declares a table over the files at a path, keeps what ``ask`` tells of it, and drops the table."""

    def told(s: SparkSession, path: str) -> DataFrame:
        name, out = f"curated_{uuid.uuid4().hex}", scratch(s, "told")
        trips.external_table(s, name, path)
        try:
            ask(s, name).write.parquet(out)
        finally:
            s.sql(f"DROP TABLE IF EXISTS {name}")
        return parquet(s, out)

    return told


add("show_partitions", round_trip("curated", trips.write_curated, declared(trips.show_partitions), fixtures.curated), f"WITH {CURATED} SELECT DISTINCT year, month FROM curated")
add("external_tables", round_trip("curated", trips.write_curated, declared(lambda s, name: by_month(s.table(name))), fixtures.curated), f"WITH {CURATED} {BY_MONTH}")
add("write_flat_copy", round_trip("flat", trips.write_flat_copy, lambda s, p: by_month(parquet(s, p)), fixtures.curated), f"WITH {CURATED} {BY_MONTH}")


def _zone_file(zones: DataFrame, path: str) -> None:
    named = zones.select(F.col("loc_id").alias("LocationID"), F.col("borough").alias("Borough"), F.col("zone").alias("Zone"), F.lit("Boro Zone, \"other\"").alias("service_zone"))
    named.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


add("read_zones", round_trip("zones", _zone_file, trips.read_zones, fixtures.zones), f"WITH {FIXTURE} SELECT loc_id, borough, zone FROM zones")
add("scan_quoted_csv", round_trip("zones", _zone_file, lambda s, p: trips.scan_quoted_csv(s, p).select("LocationID", "Borough", "Zone"), fixtures.zones), f"WITH {FIXTURE} SELECT CAST(loc_id AS VARCHAR) AS LocationID, borough AS Borough, zone AS Zone FROM zones")
add("scan_csv_inferred", round_trip("csv", trips.write_csv_copy, lambda s, p: trips.scan_csv_inferred(s, p).groupBy("pu_borough").agg(F.count("*").alias("trips"), F.sum("total_amount").alias("rev")), fixtures.curated), f"WITH {CURATED} SELECT pu_borough, count(*) AS trips, sum(total_amount) AS rev FROM curated GROUP BY pu_borough")
add("write_csv_copy", round_trip("csv", trips.write_csv_copy, lambda s, p: s.read.option("header", True).csv(p).groupBy("dataset").agg(F.count("*").alias("n")), fixtures.curated), f"WITH {CURATED} SELECT dataset, count(*) AS n FROM curated GROUP BY dataset")
add("export_tsv", round_trip("lines", trips.export_tsv, trips.scan_tsv, fixtures.curated), f"WITH {CURATED} SELECT pu_borough AS borough, pu_zone AS zone, pickup_hour AS hour FROM curated")


def _tsv_counts(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "counts")
    _by_text(s, d)[1].write.option("sep", "\t").option("nullValue", "\\N").csv(path)
    return trips.scan_tsv(s, path, trips.COUNT_SCHEMA)


add("scan_tsv", _tsv_counts, f"WITH {CURATED} {LINES}")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """The text extract with every fiftieth line's last field cut off."""
    rows = fixtures.curated(s, d).select(F.coalesce("pu_borough", F.lit("\\N")).alias("b"), F.coalesce("pu_zone", F.lit("\\N")).alias("z"), F.col("pickup_hour"), (F.unix_timestamp("pickup_ts") % 50).alias("k"))
    return rows.select(F.when(F.col("k") == 0, F.concat_ws("\t", "b", "z")).otherwise(F.concat_ws("\t", "b", "z", "pickup_hour")).alias("value"))


def _well_formed(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "lines")
    seen = rules.write_well_formed(_lines(s, d), path)
    return s.read.text(path).agg(F.count("*").alias("lines")).withColumn("malformed", F.lit(seen["malformed"]).cast("long"))


add("well_formed_lines", _well_formed, f"WITH {CURATED}, k AS (SELECT epoch(date_trunc('second', pickup_ts)) % 50 = 0 AS cut FROM curated) SELECT count(CASE WHEN NOT cut THEN 1 END) AS lines, count(CASE WHEN cut THEN 1 END) AS malformed FROM k")
add("write_gold", round_trip("gold", trips.write_gold, parquet, lambda s, d: gold.daily_kpis(fixtures.curated(s, d))), f"WITH {CURATED} {GOLD['daily']}")
DAILY_DDL = "date date, trips long, revenue double, avg_fare double, avg_distance double, avg_duration_min double"
add("scan_gold", round_trip("gold", trips.write_gold, lambda s, p: trips.scan_gold(s, p, DAILY_DDL).unionByName(trips.scan_gold(s, f"{p}-absent", DAILY_DDL)), lambda s, d: gold.daily_kpis(fixtures.curated(s, d))), f"WITH {CURATED} {GOLD['daily']}")


def _managed(s: SparkSession, d: str) -> DataFrame:
    name, out = f"zone_hour_{uuid.uuid4().hex}", scratch(s, "told")
    try:
        trips.write_managed_orc(gold.zone_hour_demand(fixtures.curated(s, d)), name)
        s.table(name).write.parquet(out)
    finally:
        s.sql(f"DROP TABLE IF EXISTS {name}")
    return parquet(s, out)


add("write_managed_orc", _managed, f"WITH {CURATED} {ZONE_HOUR}")
add("write_quality_json", round_trip("report", trips.write_report, lambda s, p: s.read.json(p).select(F.explode("report").alias("r")).select("r.rule", "r.bad_rows", "r.pct"), lambda s, d: rules.quality_report(fixtures.derived(s, d))), SQL["quality_report"])


# Storage choices: the same question of each layout
REVENUE = f"WITH {CURATED} SELECT pu_borough, count(*) AS trips, sum(total_amount) AS rev FROM curated GROUP BY pu_borough"
add("bench_format_parquet", round_trip("flat", trips.write_flat_copy, lambda s, p: gold.borough_revenue(parquet(s, p)), fixtures.curated), REVENUE)
add("bench_format_csv", round_trip("csv", trips.write_csv_copy, lambda s, p: gold.borough_revenue(s.read.schema(CURATED_SCHEMA).option("header", True).csv(p)), fixtures.curated), REVENUE)
MONTH_REVENUE = REVENUE.replace("FROM curated GROUP", "FROM curated WHERE year = 1995 AND month = 3 GROUP")
add("bench_partitioning_partitioned", round_trip("curated", trips.write_curated, lambda s, p: gold.borough_revenue(rules.partition_filter(parquet(s, p), 1995, 3)), fixtures.curated), MONTH_REVENUE)
add("bench_partitioning_flat", round_trip("flat", trips.write_flat_copy, lambda s, p: gold.borough_revenue(rules.partition_filter(parquet(s, p), 1995, 3)), fixtures.curated), MONTH_REVENUE)


def layouts(s: SparkSession, d: str) -> dict[str, Callable[[], DataFrame]]:
    """The same question of several layouts, and the zone join both ways; the layouts are written first. The flat one is the stored curated table itself."""
    curated, zones = fixtures.curated(s, d), fixtures.zones(s, d)
    csv, months = (scratch(s, n) for n in ("csv", "months"))
    trips.write_csv_copy(curated, csv)
    trips.write_curated(curated, months)
    raw = fixtures.raw_trips(s, d)
    joined = lambda join: join(raw, zones).groupBy("pu_borough").agg(F.count("*").alias("trips"))
    return {
        "parquet": lambda: gold.borough_revenue(curated), "csv": lambda: gold.borough_revenue(s.read.schema(CURATED_SCHEMA).option("header", True).csv(csv)),
        "partitioned": lambda: gold.borough_revenue(rules.partition_filter(parquet(s, months), 1995, 3)), "flat": lambda: gold.borough_revenue(rules.partition_filter(curated, 1995, 3)),
        "broadcast": lambda: joined(enrich.enrich_zones), "sort_merge": lambda: joined(enrich.enrich_zones_sortmerge),
    }


LAYOUT_PAIRS = {"format": ("parquet", "csv"), "partitions": ("partitioned", "flat"), "join": ("broadcast", "sort_merge")}
add("layout_reads", lambda s, d: measure.compare(s, layouts(s, d)))
add("comparison_findings", lambda s, d: insights.comparison_findings(measure.compare(s, layouts(s, d)), LAYOUT_PAIRS))
add("layout_rows", lambda s, d: measure.compare(s, {k: v for k, v in layouts(s, d).items() if k in ("parquet", "partitioned")}).select("layout", "rows_read"), f"WITH {CURATED} SELECT 'parquet' AS layout, count(*) AS rows_read FROM curated UNION ALL SELECT 'partitioned', count(*) FROM curated WHERE year = 1995 AND month = 3")


# Streams: the file source in place of the topic. Strays of other years are in the events and are left to the cleaning
MONTHS = ((1992, 1), (1998, 12))


def _events(s: SparkSession, d: str) -> DataFrame:
    """The events of all raw trips, stored once a session, as a topic keeps them."""
    return stored_once(s, "trip_events", fixtures.tables(d, "lineitem"), lambda: _event_rows(s, d))


def _event_rows(s: SparkSession, d: str) -> DataFrame:
    return D.trip_events(fixtures.raw_rows(s, d), "yellow")


def _events_once(s: SparkSession, d: str) -> DataFrame:
    """The events for what goes over them once: as they are made where the session has not stored them."""
    return stored_or_made(s, "trip_events", fixtures.tables(d, "lineitem"), lambda: _event_rows(s, d))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    """What the text of every event tells."""
    events = _events_once(s, d)
    return streams.parse_events(events.select(F.col("value").cast("binary").alias("value")))


def _metrics_of(s: SparkSession, d: str, path: str, window: str, late: str, files: int = streams.BACKLOG) -> DataFrame:
    events = streams.parse_events(streams.read_event_files(s, path, files))
    # every batch reads the zones: they are joined with their boroughs once
    zones = stored_once(s, "zones", fixtures.tables(d, "nation", "region"), lambda: fixtures.zones(s, d))
    return streams.zone_metrics(streams.clean_stream(events, *MONTHS), zones, window, late)


def _stream(s: SparkSession, d: str, window: str, late: str, files: int = streams.BACKLOG) -> tuple[DataFrame, str]:
    path = scratch(s, "events")
    streams.replay_stream(_events(s, d), path)
    return _metrics_of(s, d, path, window, late, files), scratch(s, "windows")


def _append(s: SparkSession, d: str, window: str = "1 day") -> DataFrame:
    metrics, path = _stream(s, d, window, "3 hours")
    streams.sink_windows_parquet(metrics, path, f"{path}-checkpoint").awaitTermination()
    return s.read.schema(streams.METRICS).parquet(path)


def _update(s: SparkSession, d: str, window: str = "1 day") -> DataFrame:
    metrics, path = _stream(s, d, window, "3 hours")
    streams.sink_windows_tables(metrics, path, f"{path}-checkpoint").awaitTermination()
    return streams.running_windows(s, path)


REPLAYED = f"year(pickup_ts)*12 + month(pickup_ts) BETWEEN {MONTHS[0][0] * 12 + MONTHS[0][1]} AND {MONTHS[1][0] * 12 + MONTHS[1][1]}"


def streamed(out_of_month: str, day: str = "day", seconds: int = 86400) -> str:
    return f"""{DERIVED}, e AS (SELECT * FROM derived WHERE {out_of_month} AND {' AND '.join(f'({k})' for n, k in KEEP.items() if n != 'out_of_month')}),
 m AS (SELECT date_trunc('{day}', pickup_ts) AS window_start, date_trunc('{day}', pickup_ts) + to_seconds({seconds}) AS window_end, PULocationID, borough AS pu_borough, zone AS pu_zone, count(*) AS trips, {mean('fare_amount', 2)} AS avg_fare, {mean('duration_min', 2)} AS avg_duration_min, {mean('trip_distance', 2)} AS avg_distance,
 {r('sum(total_amount)', 2)} AS total_revenue, {r('avg(CASE WHEN is_card THEN tip_pct END)', 2)} AS avg_card_tip_pct FROM e LEFT JOIN zones ON PULocationID = loc_id GROUP BY date_trunc('{day}', pickup_ts), PULocationID, borough, zone)"""


STREAMED = streamed(REPLAYED)
#: Windows that the watermark has passed: no watermark moves once the last input is read.
FINAL = f"WITH {STREAMED} SELECT * FROM m WHERE window_end <= (SELECT max(pickup_ts) FROM e) - to_seconds(10800)"


HOURLY = streamed(REPLAYED, "hour", 3600)


def _batch_metrics(s: SparkSession, d: str, window: str = "1 day") -> DataFrame:
    return streams.zone_metrics(streams.clean_stream(_parsed(s, d), *MONTHS), fixtures.zones(s, d), window, None)


def _live(s: SparkSession, d: str, window: str) -> DataFrame:
    """The windows as a stored table, as a board asks it: events are parsed once, however often the windows are read."""
    path = scratch(s, "live")
    _batch_metrics(s, d, window).write.parquet(path)
    return s.read.schema(streams.METRICS).parquet(path)


def _drained(s: SparkSession, d: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over all replayed events makes of them, row by row."""
    path, out = scratch(s, "events"), scratch(s, "rows")
    streams.replay_stream(_events(s, d), path)
    rows = f(streams.parse_events(streams.read_event_files(s, path, streams.BACKLOG)))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


def on_windows(name: str, f: Callable[[SparkSession, str, str], DataFrame], sql: str) -> None:
    """A question of windows of a day and, as ``..._all_months``, of the many windows of an hour."""
    add(name, lambda s, d: f(s, d, "1 day"), f"WITH {STREAMED} {sql}")
    add(f"{name}_all_months", lambda s, d: f(s, d, "1 hour"), f"WITH {HOURLY} {sql}")


EVENT_SQL = f"WITH {FIXTURE} SELECT pickup_ts, dropoff_ts, PULocationID, DOLocationID, trip_distance, passenger_count, fare_amount, tip_amount, total_amount, payment_type FROM raw"
CLEAN_SQL = f"WITH {STREAMED} SELECT pickup_ts, dropoff_ts, PULocationID, speed_mph FROM e"
add("parse_events", lambda s, d: _parsed(s, d).drop("trip_id", "dataset"), EVENT_SQL)
add("parse_events_all_months", lambda s, d: _drained(s, d, lambda e: e.drop("trip_id", "dataset")), EVENT_SQL)
add("clean_stream", lambda s, d: streams.clean_stream(_parsed(s, d), *MONTHS).select("pickup_ts", "dropoff_ts", "PULocationID", "speed_mph"), CLEAN_SQL)
add("clean_stream_all_months", lambda s, d: _drained(s, d, lambda e: streams.clean_stream(e, *MONTHS).select("pickup_ts", "dropoff_ts", "PULocationID", "speed_mph")), CLEAN_SQL)
add("clean_stream_one_month", lambda s, d: streams.clean_stream(_parsed(s, d), (1995, 3)).select("pickup_ts", "dropoff_ts", "PULocationID", "speed_mph"), f"WITH {streamed('year(pickup_ts) = 1995 AND month(pickup_ts) = 3')} SELECT pickup_ts, dropoff_ts, PULocationID, speed_mph FROM e")
on_windows("zone_metrics", _live, "SELECT * FROM m")
on_windows("append_final_windows", _append, "SELECT * FROM m WHERE window_end <= (SELECT max(pickup_ts) FROM e) - to_seconds(10800)")
on_windows("update_running_windows", _update, "SELECT * FROM m")
on_windows("live_totals", lambda s, d, w: streams.live_totals(_live(s, d, w)), "SELECT count(*) AS windows, CAST(sum(trips) AS BIGINT) AS trips, max(window_end) AS newest FROM m")
on_windows("recent_windows", lambda s, d, w: streams.recent_windows(_live(s, d, w), 20), f"SELECT window_start, CAST(sum(trips) AS BIGINT) AS trips, {mean('avg_fare', 2)} AS avg_fare FROM m GROUP BY window_start ORDER BY window_start DESC LIMIT 20")
on_windows("latest_window", lambda s, d, w: rules.latest_window(_live(s, d, w)), "SELECT * FROM m WHERE window_start = (SELECT max(window_start) FROM m)")
on_windows("busiest_live_zones", lambda s, d, w: streams.busiest_live_zones(_live(s, d, w)), "SELECT PULocationID, pu_borough, pu_zone, trips, avg_fare, avg_duration_min FROM m WHERE window_start = (SELECT max(window_start) FROM m) ORDER BY trips DESC, PULocationID LIMIT 10")
add("stream_static_zones", lambda s, d: streams.stream_static_zones(fixtures.raw_trips(s, d), fixtures.zones(s, d)).groupBy("PULocationID", "pu_borough", "pu_zone").agg(F.count("*").alias("n")), f"WITH {FIXTURE} SELECT PULocationID, borough AS pu_borough, zone AS pu_zone, count(*) AS n FROM raw LEFT JOIN zones ON PULocationID = loc_id GROUP BY PULocationID, borough, zone")
add("replay_order", lambda s, d: streams.replay_order(fixtures.raw_trips(s, d), 100, 500).select("trip_id", "PULocationID", "DOLocationID", "dropoff_ts"), f"WITH {FIXTURE} SELECT trip_id, PULocationID, DOLocationID, dropoff_ts FROM raw ORDER BY dropoff_ts, trip_id, PULocationID, DOLocationID, total_amount LIMIT 500 OFFSET 100")


def _finished(s: SparkSession, d: str, window: str = "5 minutes", late: str = "30 minutes", files: int = streams.BACKLOG):
    """A query over all events that has ended, and the progress of its batches."""
    (metrics, path), told = _stream(s, d, window, late, files), scratch(s, "progress")
    partitions = streams.FEW_PARTITIONS if files == 1 else streams.STATE_PARTITIONS
    query = streams.logged(s, told, lambda: streams.sink_windows_parquet(metrics, path, f"{path}-checkpoint", partitions=partitions))
    return query, streams.progress_rows(s, told)


def _side_by_side(s: SparkSession, d: str, shares: list, window: str, late: str) -> tuple[str, str]:
    """A query of one file a trigger over each share of the events: the folders of their windows and of their progress. All events of a zone are in one share, and so is each window."""
    out, told = scratch(s, "windows"), scratch(s, "progress")
    folders = streams.replay_shares(_events_once(s, d), scratch(s, "events"), shares)

    def start(k: int):
        metrics = _metrics_of(s, d, folders[k], window, late, 1)
        return streams.sink_windows_parquet(metrics, f"{out}/share={k}", f"{out}-checkpoint/share={k}", partitions=1)  # the other streams keep the other cores busy

    streams.logged_all(s, told, [lambda k=k: start(k) for k in range(len(shares))])
    return out, told


def _bounded(s: SparkSession, d: str) -> DataFrame:
    """The progress of batches of one file each. One stream's batches follow one another: a long backlog is dealt to streams side by side."""
    shares = streams.key_shares(fixtures.raw_rows(s, d).select(F.col("PULocationID").cast("string").alias("key")))
    if len(shares) == 1:
        return _finished(s, d, files=1)[1]
    return streams.progress_rows(s, _side_by_side(s, d, shares, "5 minutes", "30 minutes")[1])


def _committed(s: SparkSession, d: str) -> DataFrame:
    metrics, path = _stream(s, d, "1 day", "3 hours")
    streams.sink_windows_parquet(metrics, path, f"{path}-checkpoint").awaitTermination()
    return trips.committed_output(s, path)


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """Events up to a day, then, by a new query from the same checkpoint, the others."""
    path, out = scratch(s, "events"), scratch(s, "windows")
    events, day = _events(s, d), F.lit("1995-06-01").cast("timestamp")
    for some, mode in ((events.where(F.coalesce(F.col("dropoff_ts") < day, F.lit(True))), "overwrite"), (events.where(F.col("dropoff_ts") >= day), "append")):
        streams.replay_stream(some, path, mode=mode)
        streams.sink_windows_parquet(_metrics_of(s, d, path, "1 day", "3 hours"), out, f"{out}-checkpoint").awaitTermination()
    return s.read.schema(streams.METRICS).parquet(out)


def _again(s: SparkSession, d: str) -> DataFrame:
    """All events, then, by a new query from the same checkpoint, those of the first years once more: the watermark has passed them, and their windows stay as they are."""
    path, out = scratch(s, "events"), scratch(s, "windows")
    events = _events(s, d)
    for some, mode in ((events, "overwrite"), (events.where("dropoff_ts < timestamp'1997-01-01'"), "append")):
        streams.replay_stream(some, path, mode=mode)
        streams.sink_windows_parquet(_metrics_of(s, d, path, "1 day", "3 hours"), out, f"{out}-checkpoint").awaitTermination()
    return s.read.schema(streams.METRICS).parquet(out)


def _replayed(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "events")
    streams.replay_stream(_events(s, d), path)
    return s.read.parquet(path).groupBy("key").agg(F.count("*").alias("events"))


add("late_rows", lambda s, d: _finished(s, d)[1])
add("late_rows_total", lambda s, d: _finished(s, d, "1 day", "3 hours")[1].agg(F.sum("rows_in").alias("rows_in"), F.sum("late_rows").alias("late_rows")), f"WITH {FIXTURE} SELECT count(*) AS rows_in, CAST(0 AS BIGINT) AS late_rows FROM raw")
add("committed_output", _committed)
add("watermark", _again, FINAL)
add("resume_from_checkpoint", _resumed, FINAL)
add("bounded_batches", lambda s, d: _bounded(s, d).where("rows_in > 0").agg(F.count("*").alias("batches"), F.sum("rows_in").alias("rows_in")), f"WITH {FIXTURE} SELECT CAST(greatest(3, ceil(count(*)/{streams.EVENTS}.0)) AS BIGINT) AS batches, count(*) AS rows_in FROM raw")
add("drain_available", lambda s, d: (f := _finished(s, d))[1].agg(F.sum("rows_in").alias("rows_in"), F.lit(f[0].isActive).alias("active")), f"WITH {FIXTURE} SELECT count(*) AS rows_in, false AS active FROM raw")
add("replay_stream", _replayed, f"WITH {FIXTURE} SELECT CAST(PULocationID AS VARCHAR) AS key, count(*) AS events FROM raw GROUP BY PULocationID")
EVENT_ORDER = "dropoff_ts, pickup_ts, PULocationID, DOLocationID, total_amount, trip_distance, passenger_count NULLS FIRST, fare_amount, tip_amount, payment_type"
add("trip_event_fields", _parsed, f"""WITH {FIXTURE} SELECT 'yellow-' || printf('%04d%02d', file_year, file_month) || '-' || CAST(row_number() OVER (PARTITION BY file_year, file_month ORDER BY {EVENT_ORDER}) - 1 AS VARCHAR) AS trip_id, 'yellow' AS dataset,
 pickup_ts, dropoff_ts, PULocationID, DOLocationID, trip_distance, passenger_count, fare_amount, tip_amount, total_amount, payment_type FROM raw""")

# The duration model
SPLIT = f"{CURATED}, split AS (SELECT *, CASE WHEN epoch(date_trunc('second', pickup_ts)) <= {CUTOFF} THEN 'train' ELSE 'test' END AS part FROM curated)"
ERROR = "(trip_distance/(SELECT avg(speed_mph) FROM split WHERE part = 'train')*60 - duration_min)"
FEATURE_SPLIT = f"""{CURATED}, features AS (SELECT * FROM curated WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_COLUMNS)}),
split AS (SELECT *, CASE WHEN epoch(date_trunc('second', pickup_ts)) <= {CUTOFF.replace('FROM curated', 'FROM features')} THEN 'train' ELSE 'test' END AS part FROM features)"""
on_curated("naive_baseline", lambda c: duration.naive_baseline(rules.time_split(rules.feature_rows(c, MODEL_COLUMNS))))
SQL["naive_baseline"] = f"WITH {FEATURE_SPLIT} SELECT {r(f'sqrt(avg({ERROR}*{ERROR}))', 4)} AS rmse, {r(f'avg(abs({ERROR}))', 4)} AS mae, count(*) AS test_rows FROM split WHERE part = 'test'"

#: Two trees of given splits: the first on distance, hour and distance again, the second, of what the first leaves, on day and hour.
TREE_INPUTS = ["trip_distance", "pickup_hour", "pickup_dow"]
FIRST_SPLITS, SECOND_SPLITS = [(0, 6.0), (1, 11.5), (0, 9.0)], [(2, 1.5), (1, 17.5)]


def _two_trees(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature rows and the nodes of both trees."""
    rows, inputs = rules.feature_rows(c, MODEL_COLUMNS), [F.col(x).cast("double") for x in TREE_INPUTS]
    first = trees.level_tree(rows, inputs, F.col("duration_min"), FIRST_SPLITS)
    left = trees.score_nodes(rows, first, F.array(*inputs), len(FIRST_SPLITS))
    second = trees.level_tree(left, inputs, F.col("duration_min") - F.col("prediction"), SECOND_SPLITS, tree=1, weight=0.5)
    path = scratch(c.sparkSession, "nodes")
    first.unionByName(second).write.parquet(path)
    return rows, c.sparkSession.read.parquet(path)


def _leaf(splits: list[tuple[int, float]]) -> str:
    out = "0"
    for feature, threshold in splits:
        out = f"2*({out}) + CASE WHEN {TREE_INPUTS[feature]} <= {threshold} THEN 1 ELSE 2 END"
    return out


def _leaf_mean(value: str, key: str) -> str:
    return f"CAST(round(CAST(avg({value}) OVER (PARTITION BY {key}) AS DECIMAL(38,12)), 6) AS DOUBLE)"


TREE_SQL = f"""WITH {CURATED}, f AS (SELECT *, {_leaf(FIRST_SPLITS)} AS leaf0, {_leaf(SECOND_SPLITS)} AS leaf1 FROM curated WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_COLUMNS)}),
one AS (SELECT *, {_leaf_mean('duration_min', 'leaf0')} AS mean0 FROM f), two AS (SELECT *, {_leaf_mean('duration_min - mean0', 'leaf1')} AS mean1 FROM one)"""
on_curated("level_tree", lambda c: _two_trees(c)[1].where("left < 0 and value <> 0").select("tree", "node", F.round("value", 4).alias("value")))
SQL["level_tree"] = f"{TREE_SQL} SELECT DISTINCT 0 AS tree, leaf0 AS node, round(mean0, 4) AS value FROM two UNION SELECT DISTINCT 1, leaf1, round(mean1, 4) FROM two"
on_curated("score_node_table", lambda c: (lambda rows, nodes: trees.score_nodes(rows, nodes, F.array(*(F.col(x).cast("double") for x in TREE_INPUTS)), 3).groupBy("pu_borough").agg(F.count("*").alias("trips"), F.round(F.avg("prediction"), 4).alias("predicted_min")))(*_two_trees(c)))
SQL["score_node_table"] = f"{TREE_SQL} SELECT pu_borough, count(*) AS trips, round(avg(mean0 + 0.5*mean1), 4) AS predicted_min FROM two GROUP BY pu_borough"


#: Keys at which a new range of the duration table begins.
SPLITS = ["AMERICA", "ASIA", "EUROPE", "EUROPE#E", "MIDDLE EAST"]


def _duration_table(c: DataFrame) -> str:
    """The path of the serving table of predictions over the grid, by the two trees."""
    spark, path = c.sparkSession, scratch(c.sparkSession, "serving")
    boroughs = [row[0] for row in c.select("pu_borough").where("pu_borough is not null").distinct().orderBy("pu_borough").collect()]  # a handful of names
    inputs = F.array(*(F.col(x).cast("double") for x in TREE_INPUTS))
    scored = trees.score_nodes(duration.prediction_grid(spark, boroughs), _two_trees(c)[1], inputs, 3)
    serving.write_serving_table(serving.duration_rows(scored.withColumn("predicted_min", F.round("prediction", 3))), path, SPLITS)
    return path


DURATIONS = f"""{TREE_SQL}, bs AS (SELECT DISTINCT pu_borough AS b FROM curated WHERE pu_borough IS NOT NULL),
g AS (SELECT CAST(h.range AS INTEGER) AS pickup_hour, CAST(m.range AS DOUBLE) AS trip_distance, w.d AS pickup_dow, x.b AS pu, y.b AS do_ FROM range(24) h, range(1, 31) m, (SELECT 4 AS d UNION ALL SELECT 7) w, bs x, bs y),
l AS (SELECT *, {_leaf(FIRST_SPLITS)} AS leaf0, {_leaf(SECOND_SPLITS)} AS leaf1 FROM g),
rows AS (SELECT concat_ws('#', pu, do_, CASE WHEN pickup_dow = 7 THEN 'weekend' ELSE 'weekday' END, lpad(CAST(pickup_hour AS VARCHAR), 2, '0'), lpad(printf('%.1f', trip_distance), 4, '0')) AS row_key, round(coalesce(mean0, 0) + 0.5*coalesce(mean1, 0), 3) AS minutes
 FROM l LEFT JOIN (SELECT DISTINCT leaf0, mean0 FROM two) USING (leaf0) LEFT JOIN (SELECT DISTINCT leaf1, mean1 FROM two) USING (leaf1))"""
RANGE_SQL = " + ".join(f"CASE WHEN row_key >= '{k}' THEN 1 ELSE 0 END" for k in SPLITS)
on_curated("duration_table", lambda c: parquet(c.sparkSession, _duration_table(c)).select("row_key", "minutes", "range"))
SQL["duration_table"] = f"{DURATIONS} SELECT row_key, minutes, {RANGE_SQL} AS range FROM rows"
on_curated("duration_get", lambda c: serving.ServingTable(c.sparkSession, _duration_table(c)).get("ASIA#EUROPE#weekday#08#05.0", ["minutes"]))
SQL["duration_get"] = f"{DURATIONS} SELECT row_key, minutes FROM rows WHERE row_key = 'ASIA#EUROPE#weekday#08#05.0'"
on_curated("duration_prefix", lambda c: serving.ServingTable(c.sparkSession, _duration_table(c)).prefix("EUROPE#ASIA#weekend#", ["minutes"]))
SQL["duration_prefix"] = f"{DURATIONS} SELECT row_key, minutes FROM rows WHERE starts_with(row_key, 'EUROPE#ASIA#weekend#')"
on_curated("duration_cells", lambda c: serving.cells(serving.ServingTable(c.sparkSession, _duration_table(c)).range("AFRICA#AFRICA#", "AFRICA#ASIA"), serving.DURATION_FAMILIES).select("row_key", "cell", F.col("value").cast("double").alias("value")))
SQL["duration_cells"] = f"{DURATIONS} SELECT row_key, 'p:minutes' AS cell, minutes AS value FROM rows WHERE row_key >= 'AFRICA#AFRICA#' AND row_key < 'AFRICA#ASIA'"
on_gold("daily_cells", "daily", lambda d: serving.cells(serving.daily_rows(d), serving.DAILY_FAMILIES).where("cell = 'k:trips'"), f", {DAILY_ROWS} SELECT row_key, 'k:trips' AS cell, CAST(trips AS VARCHAR) AS value FROM rows")


def _fitted(c: DataFrame):
    """Split feature rows and the model of the train part, whose rows of equal features are fitted as one."""
    inputs, spark = duration.feature_selection("yellow"), c.sparkSession
    train = scratch(spark, "train")
    split = rules.time_split(rules.feature_rows(c, [*inputs, duration.LABEL])).select(*inputs, duration.LABEL, "speed_mph", "part")
    # every tree goes over these rows for each of its levels: they are dealt over all cores
    duration.equal_rows(split.where("part = 'train'"), inputs).repartition(spark.sparkContext.defaultParallelism).write.parquet(train)
    return inputs, split, duration.duration_pipeline(inputs, weight="weight").fit(spark.read.parquet(train))


def on_model(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """``f`` gets what the model needs of curated trips."""
    columns = [*duration.feature_selection("yellow"), duration.LABEL, "speed_mph", "pickup_ts"]
    add(name, lambda s, d: f(fixtures.model_rows(s, d, columns)))


def _evaluated(c: DataFrame) -> DataFrame:
    _, split, model = _fitted(c)
    return duration.evaluate_model(model, split, duration.naive_baseline(split).first()["rmse"])


def _importance(c: DataFrame) -> DataFrame:
    inputs, split, model = _fitted(c)
    path = scratch(c.sparkSession, "model")
    duration.save_model(model, path)
    return duration.rescore_importance(path, split, inputs)


def _scored(c: DataFrame) -> DataFrame:
    _, _, model = _fitted(c)
    boroughs = [row[0] for row in c.select("pu_borough").where("pu_borough is not null").distinct().orderBy("pu_borough").collect()]  # a handful of names
    return duration.score_grid(model, duration.prediction_grid(c.sparkSession, boroughs))


def _model_findings(c: DataFrame) -> DataFrame:
    inputs, split, model = _fitted(c)
    evaluation = duration.evaluate_model(model, split, duration.naive_baseline(split).first()["rmse"])
    return insights.model_findings(evaluation, duration.feature_importance(model, split, inputs))


on_model("evaluate_model", _evaluated)
on_model("model_findings", _model_findings)
on_model("feature_importance", _importance)
on_model("score_grid", _scored)
on_model("predict_lookup", lambda c: duration.predict_lookup(_scored(c), "ASIA", "EUROPE", 4, 5.0))
on_model("fastest_hour", lambda c: duration.fastest_hour(duration.predict_lookup(_scored(c), "ASIA", "EUROPE", 4, 5.0), 8))
add("prediction_grid", lambda s, d: fixtures.zones(s, d).select("borough").distinct().transform(lambda b: duration.prediction_grid(s, [x[0] for x in b.collect()])), """WITH z AS (SELECT r_name AS borough FROM region), h AS (SELECT CAST(range AS INTEGER) AS pickup_hour FROM range(24)), m AS (SELECT CAST(range AS DOUBLE) AS trip_distance FROM range(1, 31)), w AS (SELECT 4 AS pickup_dow UNION ALL SELECT 7)
SELECT pickup_hour, pickup_dow, trip_distance, a.borough AS pu_borough, c.borough AS do_borough, CAST(1.0 AS DOUBLE) AS passenger_count FROM h, w, m, z a, z c""")
on_gold("nearest_grid_distance", "routes", lambda t: duration.nearest_grid_distance(t.sparkSession.range(1, 31).select(F.col("id").cast("double").alias("trip_distance")), t), ", g AS (SELECT CAST(range AS DOUBLE) AS miles FROM range(1, 31)), o AS (SELECT pu_borough, do_borough, miles, row_number() OVER (PARTITION BY pu_borough, do_borough ORDER BY abs(miles - avg_distance), miles) AS n FROM routes, g WHERE avg_distance IS NOT NULL) SELECT pu_borough, do_borough, miles AS grid_miles FROM o WHERE n = 1")
