"""The curated trip contract and the thresholds of the cleaning rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Each dataset kind's pickup and dropoff columns.
TIMESTAMPS = {
    "yellow": ("tpep_pickup_datetime", "tpep_dropoff_datetime"),
    "green": ("lpep_pickup_datetime", "lpep_dropoff_datetime"),
    "fhvhv": ("pickup_datetime", "dropoff_datetime"),
    "fhv": ("pickup_datetime", "dropOff_datetime"),
}

#: Columns that a raw file may lack, with their types.
OPTIONAL = {"trip_distance": "double", "fare_amount": "double", "tip_amount": "double", "total_amount": "double", "passenger_count": "double", "payment_type": "int"}

#: The curated columns in order; year and month are partition keys.
CURATED = (
    "pickup_ts timestamp, dropoff_ts timestamp, duration_s long, duration_min double, trip_distance double, speed_mph double, passenger_count double, "
    "fare_amount double, tip_amount double, total_amount double, tip_pct double, payment_type int, is_card boolean, is_weekend boolean, pickup_hour int, pickup_dow int, "
    "PULocationID int, DOLocationID int, pu_borough string, pu_zone string, do_borough string, do_zone string, dataset string, year int, month int"
)


def schema_of(ddl: str) -> T.StructType:
    """A schema of plain types; needs no session, unlike Spark's own parser."""
    kinds = {"timestamp": T.TimestampType(), "long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


CURATED_SCHEMA = schema_of(CURATED)
CURATED_COLUMNS = CURATED_SCHEMA.names

#: One trip event of a stream.
EVENT = (
    "trip_id string, dataset string, pickup_ts timestamp, dropoff_ts timestamp, PULocationID int, DOLocationID int, trip_distance double, passenger_count double, "
    "fare_amount double, tip_amount double, total_amount double, payment_type int"
)


@dataclass(frozen=True)
class Thresholds:
    """What a plausible trip looks like."""

    least_seconds: int = 60
    most_seconds: int = 21_600
    most_miles: float = 100.0
    most_mph: float = 90.0


DEFAULTS = Thresholds()
