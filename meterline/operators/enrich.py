"""Joins of trips with the zone dimension.

The zone table is a dimension of a few hundred rows. It is broadcast while its row count
stays below ``MOST_ZONES``; a larger one is joined by sort-merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the dimension is broadcast: some megabytes.
MOST_ZONES = 50_000


def _joined(trips: DataFrame, zones: DataFrame, how) -> DataFrame:
    """``how`` marks the dimension for broadcast or merge."""
    for side, key in (("pu", "PULocationID"), ("do", "DOLocationID")):
        named = zones.select(F.col("loc_id").alias(f"{side}_loc"), F.col("borough").alias(f"{side}_borough"), F.col("zone").alias(f"{side}_zone"))
        trips = trips.join(how(named), F.col(key) == F.col(f"{side}_loc"), "left").drop(f"{side}_loc")
    return trips


def marked(zones: DataFrame, most_zones: int = MOST_ZONES):
    """How to mark the dimension: for broadcast while it is small, else for merge."""
    return _merge if zones.limit(most_zones + 1).count() > most_zones else F.broadcast


def _merge(zones: DataFrame) -> DataFrame:
    return zones.hint("merge")


def enrich_zones(trips: DataFrame, zones: DataFrame, most_zones: int = MOST_ZONES) -> DataFrame:
    """Adds borough and zone of both ends; unmatched ids keep the trip with nulls."""
    return _joined(trips, zones, marked(zones, most_zones))


def enrich_zones_sortmerge(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return _joined(trips, zones, _merge)


def trips_per_borough(keyed: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips of each borough from string location ids; ids that are no numbers match nothing."""
    joined = keyed.withColumn("id", F.col("location").try_cast("bigint")).join(zones, F.col("id") == F.col("loc_id"))
    return joined.groupBy("borough").agg(F.count("*").alias("trips"))
