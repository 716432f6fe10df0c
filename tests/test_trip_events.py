"""One event a trip, also without a dropoff."""

import datetime as dt
import json

from meterline.functions import derive
from tests.test_trips import RAW, START, row


def test_null_dropoffs_keep_their_events(spark):
    lost = list(row())
    lost[1] = None
    rows = spark.createDataFrame([row(), tuple(lost), row(start=START + dt.timedelta(days=1))], RAW)
    events = [(r.number, json.loads(r.value)["dropoff_ts"] is None) for r in derive.trip_events(rows, "yellow", "202401").collect()]
    assert sorted(events) == [(0, True), (1, False), (2, False)]
