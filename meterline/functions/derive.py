"""Column derivations of trips. Every function maps a DataFrame or Columns to the same, without actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.plans.contract import CURATED_COLUMNS, CURATED_SCHEMA, OPTIONAL, TIMESTAMPS


#: Magnitude below which a scaled double's error is far below ``NEAR_HALF``, and how near to a half of the last place decimals are asked: their six places move a value times 100 by 0.00005 at most.
LARGE, NEAR_HALF = 1e9, 1e-3


def rounded(x: Column | str, places: int) -> Column:
    """Half-up rounding of the decimal value, independent of the double's binary tail."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double").try_cast("decimal(38,6)"), places).cast("double")


def rounded_row(x: Column, places: int) -> Column:
    """As :func:`rounded`, to three places at most, for values below 10**12 such as a single trip's. Decimals are asked only near a half of the last place, where a double's tail could decide, and for large values and none."""
    exact = F.round(x.try_cast("decimal(18,6)"), places).cast("double")
    scaled = x.cast("double") * 10**places
    clear = (F.abs(scaled) < LARGE) & (F.abs(scaled - F.floor(scaled) - 0.5) > NEAR_HALF)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0**places)).otherwise(exact)


def normalise_timestamps(df: DataFrame, dataset: str) -> DataFrame:
    pickup, dropoff = TIMESTAMPS[dataset]
    return df.withColumnsRenamed({pickup: "pickup_ts", dropoff: "dropoff_ts"})


def normalise_fhvhv(df: DataFrame) -> DataFrame:
    """Distance and tips under their common names; the fare is the base fare and all charges."""
    charges = ["tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee"]

    def money(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    fare = money("base_passenger_fare")
    for name in charges:
        fare = fare + money(name)
    tip = money("tips")
    return df.withColumns({"fare_amount": fare, "total_amount": fare + tip}).withColumnsRenamed({"trip_miles": "trip_distance", "tips": "tip_amount"})


def fill_contract_columns(df: DataFrame) -> DataFrame:
    """Columns that the dataset lacks, as typed nulls."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in df.columns})


def normalise(df: DataFrame, dataset: str) -> DataFrame:
    df = normalise_timestamps(df, dataset)
    return widen_types(fill_contract_columns(normalise_fhvhv(df) if dataset == "fhvhv" else df))


def widen_types(df: DataFrame) -> DataFrame:
    """One type for each contract column, whatever width a file stored."""
    kinds = {f.name: f.dataType for f in CURATED_SCHEMA}
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in df.columns if c in kinds})


def duration_s() -> Column:
    return F.unix_timestamp("dropoff_ts") - F.unix_timestamp("pickup_ts")


def duration_min() -> Column:
    return rounded_row(duration_s() / 60, 2)


def speed_mph() -> Column:
    """Null unless the trip took time."""
    return F.when(duration_s() > 0, rounded_row(F.col("trip_distance") / (duration_s() / 3600), 2))


def is_card() -> Column:
    return F.col("payment_type") == 1


def tip_pct() -> Column:
    """Null unless there was a fare."""
    return F.when(F.col("fare_amount") > 0, rounded_row(100 * F.col("tip_amount") / F.col("fare_amount"), 2))


def pickup_calendar() -> dict[str, Column]:
    return {"pickup_hour": F.hour("pickup_ts"), "pickup_dow": F.dayofweek("pickup_ts"), "is_weekend": F.dayofweek("pickup_ts").isin(1, 7)}


def derive_trips(df: DataFrame) -> DataFrame:
    """All derived columns at once."""
    return df.withColumns({"duration_s": duration_s(), "duration_min": duration_min(), "speed_mph": speed_mph(), "is_card": is_card(), "tip_pct": tip_pct()} | pickup_calendar())


def to_contract(df: DataFrame, dataset: str) -> DataFrame:
    """The curated columns in order and type; ``file_year`` and ``file_month`` become the partition keys."""
    df = df.withColumns({"dataset": F.lit(dataset), "year": F.col("file_year"), "month": F.col("file_month")})
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CURATED_SCHEMA))


def is_contract(df: DataFrame) -> bool:
    return df.columns == CURATED_COLUMNS and all(a.dataType == b.dataType for a, b in zip(df.schema, CURATED_SCHEMA))


def day_type(weekend: Column | str = "is_weekend") -> Column:
    weekend = F.col(weekend) if isinstance(weekend, str) else weekend
    return F.when(weekend, "weekend").otherwise("weekday")


def day_type_of_dow(dow: Column | str = "pickup_dow") -> Column:
    dow = F.col(dow) if isinstance(dow, str) else dow
    return day_type(dow.isin(1, 7))


def payment_label(card: str = "is_card") -> Column:
    """An unknown payment counts as no card."""
    return F.when(F.col(card), "card").otherwise("cash/other")


def route_label(pickup: str = "pu_zone", dropoff: str = "do_zone") -> Column:
    return F.concat(F.col(pickup), F.lit(" → "), F.col(dropoff))


def earn_per_hour(fare: str = "avg_fare", minutes: str = "avg_duration_min") -> Column:
    return F.when(F.col(minutes) > 0, rounded(F.col(fare) / (F.col(minutes) / 60), 2))


def trip_events(df: DataFrame, dataset: str, year_month: str | None = None) -> DataFrame:
    """(key, value): each trip as JSON, keyed by pickup zone, nulls kept; ids count trips by dropoff within their file month,
    which is ``year_month`` for all or, without it, told by file_year and file_month.

    Numbering is spread over the hours of the dropoff: positions within an hour, plus the sizes of the hours before, of which there are few.
    """
    from pyspark.sql import Window

    order = ["dropoff_ts", "pickup_ts", "PULocationID", "DOLocationID", "total_amount", "trip_distance", "passenger_count", "fare_amount", "tip_amount", "payment_type"]
    # keys are numbers without nulls: the join takes rows as the numbering has dealt them; a trip without a dropoff is numbered first
    year, month = ((F.lit(-1), F.lit(-1)) if year_month else (F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in ("file_year", "file_month")))
    hour = F.coalesce(F.expr("unix_timestamp(dropoff_ts) div 3600"), F.lit(-(2**62)))
    keys = ["range", "of_year", "of_month"]
    dealt = df.select(hour.alias("range"), year.alias("of_year"), month.alias("of_month"), *order)
    sizes = dealt.groupBy(*keys).count()
    before = sizes.select(*keys, (F.coalesce(F.sum("count").over(Window.partitionBy("of_year", "of_month").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = dealt.withColumn("within", within).join(before, keys).withColumn("number", F.col("before") + F.col("within") - 1)
    year, month = (F.nullif(F.col(c), F.lit(-1)) for c in ("of_year", "of_month"))
    # format_string is dear for each trip
    usual = F.col("of_year").between(1000, 9999) & F.col("of_month").between(1, 12)
    file = F.lit(year_month) if year_month else F.when(usual, (F.col("of_year") * 100 + F.col("of_month")).cast("string")).otherwise(F.format_string("%04d%02d", year, month))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    event = F.struct(
        F.concat_ws("-", F.lit(dataset), file, F.col("number").cast("string")).alias("trip_id"), F.lit(dataset).alias("dataset"), F.date_format("pickup_ts", iso).alias("pickup_ts"), F.date_format("dropoff_ts", iso).alias("dropoff_ts"),
        *(F.col(c).cast("int").alias(c) for c in ("PULocationID", "DOLocationID")),
        *(F.col(c).cast("double").alias(c) for c in ("trip_distance", "passenger_count", "fare_amount", "tip_amount", "total_amount")), F.col("payment_type").cast("int").alias("payment_type"),
    )
    return numbered.select(F.col("PULocationID").cast("string").alias("key"), F.to_json(event, {"ignoreNullFields": "false"}).alias("value"), "dropoff_ts", "number")
