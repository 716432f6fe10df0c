"""What a query read and shuffled, as Spark's own task metrics tell it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

READS = "layout string, bytes_read long, rows_read long, shuffle_bytes long, seconds double"


def measured(spark: SparkSession, ask: Callable[[], DataFrame]) -> dict[str, float]:
    """Runs a query whose result is small, and sums up the metrics of its stages. Jobs that Spark runs for a broadcast are not among them."""
    context, group = spark.sparkContext, f"measured-{uuid.uuid4().hex}"
    context.setJobGroup(group, "measured")
    began = time.time()
    try:
        ask().collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    out = {"bytes_read": 0, "rows_read": 0, "shuffle_bytes": 0, "seconds": time.time() - began}
    core, tracker = context._jsc.sc(), context.statusTracker()
    core.listenerBus().waitUntilEmpty()
    stages = {k for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for k in info.stageIds}
    for stage in sorted(stages):
        try:
            told = core.statusStore().lastStageAttempt(stage)
        except Py4JJavaError:
            continue  # a stage that was not needed
        out["bytes_read"] += told.inputBytes()
        out["rows_read"] += told.inputRecords()
        out["shuffle_bytes"] += told.shuffleWriteBytes()
    return out


def compare(spark: SparkSession, layouts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """``READS``: one row for each of several ways to the same answer."""
    rows = [(name, *(f[k] for k in ("bytes_read", "rows_read", "shuffle_bytes")), float(f["seconds"])) for name, ask in layouts.items() for f in [measured(spark, ask)]]
    return spark.createDataFrame(rows, READS)
