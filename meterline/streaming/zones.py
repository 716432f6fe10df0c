"""Trip events as a stream: parse, clean, enrich, and windowed zone metrics. The batch functions are reused as they are."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from meterline.functions.derive import derive_trips, rounded
from meterline.operators.enrich import marked
from meterline.operators.rules import clean_trips, latest_window
from meterline.plans.contract import EVENT, schema_of
from meterline.sources.folders import file_system, listed

EVENT_SCHEMA = schema_of(EVENT)
#: Events of a replayed file, as many as a trigger takes of a topic.
EVENTS = 50_000
#: Replayed files that a trigger takes of a backlog: two for each core of a small cluster, 1.2 million events.
BACKLOG = 24
#: Partitions of a stream's state at most. Each costs a store's load and commit in every batch, whatever it holds, and a watermark keeps the state small.
STATE_PARTITIONS = 12
#: Changed windows of a day that one task writes.
DAY_ROWS = 100_000
#: Folders that are listed or removed at the same time.
LISTERS = 16
#: Partitions of state where a trigger takes one file, which one task reads.
FEW_PARTITIONS = 2
#: Streams side by side over a topic's shares at most: some for each core of a small cluster, as a stream of small batches leaves its core again and again.
STREAMS = 32
#: Files of a share at least, so that its files of one size hold a twenty-fourth more than ``EVENTS`` at most.
SHARE_FILES = 24
#: What writes checkpoints. On a mounted folder Spark's usual one starts a process of the system for each link that it looks for, some 35 a batch on the driver; the other one renames files there without.
CHECKPOINTS, LOCAL_CHECKPOINTS = "spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
#: Parts of a topic, to which keys are dealt by their hash.
KEY_PARTS = 4_096
METRICS = "window_start timestamp, window_end timestamp, PULocationID int, pu_borough string, pu_zone string, trips long, avg_fare double, avg_duration_min double, avg_distance double, total_revenue double, avg_card_tip_pct double"


def read_trip_stream(spark: SparkSession, servers: str, topic: str = "trips", most: int = 50_000) -> DataFrame:
    """Events of a topic from its earliest offset, at most ``most`` a trigger."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": most, "failOnDataLoss": "false"}
    return spark.readStream.format("kafka").options(**options).load()


def read_event_files(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The file twin of the topic: parquet files of binary ``value``, ``files`` a trigger."""
    return spark.readStream.schema("value binary").option("maxFilesPerTrigger", files).parquet(path)


def parse_events(records: DataFrame) -> DataFrame:
    """The fields of each event. They come from a generator, below which no filter on them is pushed: each of its fields would parse the text again."""
    event = F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)
    more = ["timestamp"] if "timestamp" in records.columns else []
    return records.select(F.inline(F.array(event)), *more)


def clean_stream(events: DataFrame, first: tuple[int, int], last: tuple[int, int] | None = None) -> DataFrame:
    """Derives and cleans before any watermark: one stray future pickup would expire all state.

    ``first`` and ``last`` are the replayed months, as (year, month); a pickup of another month is out. Without ``last`` there is one.
    """
    year, month = F.year("pickup_ts"), F.month("pickup_ts")
    (y0, m0), (y1, m1) = first, last or first
    replayed = (year * 12 + month).between(y0 * 12 + m0, y1 * 12 + m1)
    return clean_trips(derive_trips(events.withColumns({"file_year": F.when(replayed, year), "file_month": F.when(replayed, month)})))


def stream_static_zones(events: DataFrame, zones: DataFrame) -> DataFrame:
    named = zones.select(F.col("loc_id").alias("PULocationID"), F.col("borough").alias("pu_borough"), F.col("zone").alias("pu_zone"))
    return events.join(marked(zones)(named), "PULocationID", "left")


def zone_metrics(clean: DataFrame, zones: DataFrame, window: str = "5 minutes", late: str | None = "30 minutes") -> DataFrame:
    """Tumbling windows by pickup zone; card tips leave other payments out. Works on a stream and, with ``late`` None, on a batch."""
    if late is not None:
        clean = clean.withWatermark("pickup_ts", late)
    named = stream_static_zones(clean, zones)
    card = F.avg(F.when(F.col("is_card"), F.col("tip_pct")))
    grouped = named.groupBy(F.window("pickup_ts", window).alias("w"), "PULocationID", "pu_borough", "pu_zone").agg(
        F.count("*").alias("trips"), rounded(F.avg("fare_amount"), 2).alias("avg_fare"), rounded(F.avg("duration_min"), 2).alias("avg_duration_min"), rounded(F.avg("trip_distance"), 2).alias("avg_distance"),
        rounded(F.sum("total_amount"), 2).alias("total_revenue"), rounded(card, 2).alias("avg_card_tip_pct"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *grouped.columns[1:])


def _start(writer: DataStreamWriter, spark: SparkSession, checkpoint: str, every: str | None, partitions: int = STATE_PARTITIONS) -> StreamingQuery:
    """Starts a query with at most ``partitions`` of state: a query keeps what the session has set when it starts, and its checkpoint keeps the partitions after that."""
    kept = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions))}
    if file_system(spark, checkpoint)[0].getScheme() == "file" and not spark.conf.get(CHECKPOINTS, None):
        kept[CHECKPOINTS] = LOCAL_CHECKPOINTS
    before = {name: spark.conf.get(name, None) for name in kept}
    for name, value in kept.items():
        spark.conf.set(name, value)
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def sink_windows_parquet(metrics: DataFrame, path: str, checkpoint: str, every: str | None = None, partitions: int = STATE_PARTITIONS) -> StreamingQuery:
    """Appends each window once, when the watermark has passed it. Without ``every``, drains what is there and stops. ``partitions`` of state suit a trigger's events."""
    writer = metrics.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer, metrics.sparkSession, checkpoint, every, partitions)


def as_messages(metrics: DataFrame) -> DataFrame:
    """(key, value): the zone id and all columns as JSON."""
    return metrics.select(F.col("PULocationID").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def sink_windows_topic(metrics: DataFrame, servers: str, topic: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Sends each window as it changes."""
    writer = as_messages(metrics).writeStream.format("kafka").outputMode("update").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    return _start(writer, metrics.sparkSession, checkpoint, every)


def sink_windows_tables(metrics: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The update sink over files: a table with one row for each window and zone, as it stands now (:func:`running_windows`)."""

    def write(batch: DataFrame, number: int) -> None:
        merge_windows(batch, path, number)

    writer = metrics.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(writer, metrics.sparkSession, checkpoint, every)


def _versions(spark: SparkSession, path: str, day: str) -> list[int]:
    """The batches that have written a day, oldest first."""
    return sorted(int(name.removeprefix("batch=")) for name in listed(spark, f"{path}/day={day}") if name.startswith("batch="))


def merge_windows(changed: DataFrame, path: str, number: int) -> None:
    """Puts a batch's changed windows in place of their older rows, in the partitions of their days.

    A day's new version is written beside the one that it comes from, and only versions before that are removed: a
    batch that is given again starts from the same version and writes the same. Days without a changed window are not touched.
    """
    spark = changed.sparkSession
    rows = changed.withColumn("day", F.to_date("window_start")).persist()
    sizes = {str(r.day): r["count"] for r in rows.groupBy("day").count().collect()}  # of one batch's windows
    if not sizes:
        rows.unpersist()
        return
    there = {name.removeprefix("day=") for name in listed(spark, path)}
    with ThreadPoolExecutor(LISTERS) as listers:
        versions = dict(zip(sizes, listers.map(lambda day: _versions(spark, path, day) if day in there else [], sizes)))
    bases = {day: max((v for v in there if v < number), default=None) for day, there in versions.items()}
    older = [f"{path}/day={day}/batch={v}" for day, v in bases.items() if v is not None]
    if older:
        kept = _read_days(spark, older).withColumn("day", F.to_date("window_start"))
        keys = rows.select(F.col("window_start").alias("w"), F.col("PULocationID").alias("z"))
        rows_now = rows.unionByName(kept.join(keys, (F.col("window_start") == F.col("w")) & F.col("PULocationID").eqNullSafe(F.col("z")), "left_anti"))
    else:
        rows_now = rows
    parts = -(-max(sizes.values()) // DAY_ROWS)
    by_day = rows_now.withColumn("batch", F.lit(number)).repartition("day", F.pmod(F.xxhash64("PULocationID"), F.lit(parts)))
    by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    rows.unpersist()
    fs, of = file_system(spark, path)
    gone = [f"{path}/day={day}/batch={v}" for day, base in bases.items() if base is not None for v in versions[day] if v < base]
    with ThreadPoolExecutor(LISTERS) as listers:
        list(listers.map(lambda folder: fs.delete(of(folder), True), gone))


def _read_days(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The windows in some folders. Above some thirty, Spark lists them in a job with a task for each: a few tasks do."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTERS)))
    try:
        return spark.read.schema(METRICS).parquet(*folders)
    finally:
        spark.conf.set(name, before)


def running_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that :func:`sink_windows_tables` has written, each as it stands now."""
    days = [name.removeprefix("day=") for name in listed(spark, path) if name.startswith("day=")]
    with ThreadPoolExecutor(LISTERS) as listers:
        newest = list(listers.map(lambda day: f"{path}/day={day}/batch={max(_versions(spark, path, day))}", days))
    return _read_days(spark, newest) if newest else spark.createDataFrame([], METRICS)


#: Batches whose progress is held before it is written.
HELD = 100


class _AsJson:
    """What Spark calls for a :class:`ProgressLog`: of a batch's progress it takes the JSON alone. An object of Python for each of its parts takes the driver some tenth of a second a batch."""

    def __init__(self, log: ProgressLog):
        self._log = log

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._log.told(event.progress().json())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._log.ended(event.runId().toString())

    class Java:
        implements = ["org.apache.spark.sql.streaming.PythonStreamingQueryListener"]


class ProgressLog(StreamingQueryListener):
    """Keeps what every micro-batch tells of itself as lines of JSON in a folder: batches of a query are never forgotten, however many there are."""

    def __init__(self, spark: SparkSession, path: str, held: int = HELD):
        self._spark, self.path, self._held = spark, path, held
        self._listener = None
        self._lines: list[str] = []
        self._files = 0
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def _write(self) -> None:
        with self._lock:
            lines, self._lines = self._lines, []
            self._files += 1
            name = f"{self.path}/progress-{self._files:06d}-{uuid.uuid4().hex}.json"
        if lines:
            fs, of = file_system(self._spark, self.path)
            out = fs.create(of(name))
            try:
                out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
            finally:
                out.close()

    def onQueryStarted(self, event) -> None:
        pass

    @property
    def _jlistener(self):
        if self._listener is None:
            self._listener = self._spark.sparkContext._jvm.PythonStreamingQueryListenerWrapper(_AsJson(self))
        return self._listener

    def told(self, progress: str) -> None:
        with self._lock:
            self._lines.append(" ".join(progress.split("\n")))
            full = len(self._lines) >= self._held
        if full:
            self._write()

    def ended(self, run: str) -> None:
        self._write()
        self._end_of(run).set()

    def onQueryProgress(self, event) -> None:
        self.told(event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the progress of a query that has ended is written; listeners are told of it a little later."""
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError("the end of the query was not told")


def logged(spark: SparkSession, path: str, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query that ends by itself, and keeps the progress of all its batches at ``path``."""
    return logged_all(spark, path, [start])[0]


def logged_all(spark: SparkSession, path: str, starts: list[Callable[[], StreamingQuery]]) -> list[StreamingQuery]:
    """As :func:`logged`, for queries side by side. Where one fails, all are stopped."""
    log, queries = ProgressLog(spark, path), []
    spark.streams.addListener(log)
    try:
        for start in starts:
            queries.append(start())
        for query in queries:
            query.awaitTermination()
        for query in queries:
            log.wait(query)
    finally:
        for query in queries:
            query.stop()
        spark.streams.removeListener(log)
    return queries


PROGRESS = (
    "runId string, batchId long, numInputRows long, processedRowsPerSecond double, eventTime struct<watermark: string>, stateOperators array<struct<numRowsDroppedByWatermark: long, numRowsTotal: long>>, "
    "sources array<struct<metrics: struct<maxOffsetsBehindLatest: string>>>"
)


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """What queries told of their micro-batches: input, late rows dropped, state rows, watermark, and how far a topic was ahead."""
    told = spark.read.schema(PROGRESS).json(path)
    state = F.get("stateOperators", F.lit(0))
    return told.select(
        F.col("batchId").alias("batch"), F.col("numInputRows").alias("rows_in"), F.coalesce("processedRowsPerSecond", F.lit(0.0)).alias("rows_per_second"), F.coalesce(state["numRowsDroppedByWatermark"], F.lit(0)).alias("late_rows"),
        F.coalesce(state["numRowsTotal"], F.lit(0)).alias("state_rows"), F.col("eventTime.watermark").alias("watermark"), F.get("sources", F.lit(0))["metrics"]["maxOffsetsBehindLatest"].cast("long").alias("behind"),
    )


def live_totals(metrics: DataFrame) -> DataFrame:
    """Zone windows written, their trips and the newest window's end."""
    return metrics.agg(F.count("*").alias("windows"), F.sum("trips").alias("trips"), F.max("window_end").alias("newest"))


def recent_windows(metrics: DataFrame, last: int = 144) -> DataFrame:
    """Trips and the plain mean of the zones' fares of each of the last windows."""
    return metrics.groupBy("window_start").agg(F.sum("trips").alias("trips"), rounded(F.avg("avg_fare"), 2).alias("avg_fare")).orderBy(F.desc("window_start")).limit(last)


def busiest_live_zones(metrics: DataFrame, top: int = 10) -> DataFrame:
    return latest_window(metrics).select("PULocationID", "pu_borough", "pu_zone", "trips", "avg_fare", "avg_duration_min").orderBy(F.desc("trips"), "PULocationID").limit(top)


def replay_order(trips: DataFrame, skip: int = 0, limit: int = 0) -> DataFrame:
    """Trips in dropoff order without the first ``skip``, at most ``limit`` if that is not 0."""
    ordered = trips.orderBy("dropoff_ts", "trip_id", "PULocationID", "DOLocationID", "total_amount").offset(skip)
    return ordered.limit(limit) if limit else ordered


def files_of(events: int) -> int:
    """Replayed files of so many events."""
    return max(3, -(-events // EVENTS))


def replay_stream(events: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Writes (key, value, dropoff_ts) events to files in dropoff order, for :func:`read_event_files`: ``files`` or,
    without it, one for each ``EVENTS`` rows, three at least.
    """
    files = files or files_of(events.count())
    spark, staged = events.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    fs, of = file_system(spark, path)
    if mode == "overwrite":
        fs.delete(of(path), True)
    ordered = events.repartitionByRange(files, "dropoff_ts").sortWithinPartitions("dropoff_ts")
    ordered.select("key", F.col("value").cast("binary").alias("value")).write.parquet(staged)
    # The file source takes the oldest file first, and of one time the first by name. Files move in order, one after another: a store that
    # copies gives them ascending times, and on one that keeps times these are set
    before = [x for x in fs.listStatus(of(path)) if not x.getPath().getName().startswith("_")]
    began = max((x.getModificationTime() + 1000 for x in before), default=1_000_000)
    first = max((int(name.split("-")[1]) + 1 for x in before if (name := x.getPath().getName()).startswith("events-")), default=0)
    for k, name in enumerate(n for n in listed(spark, staged) if n.startswith("part-")):
        target = of(f"{path}/events-{first + k:08d}-{uuid.uuid4().hex}.parquet")
        if not fs.rename(of(f"{staged}/{name}"), target):
            raise OSError(f"could not move {name} to {target}")
        fs.setTimes(target, began + 1000 * k, -1)
    fs.delete(of(staged), True)


def _part() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(KEY_PARTS)).cast("int")


def key_shares(keys: DataFrame) -> list[tuple[list[int], int]]:
    """Deals the ``key`` of all events to shares of about equal size, for streams side by side: the parts and the number of files of each.

    All shares together have the files of one replay, and each has ``SHARE_FILES`` at least; events of fewer files are one share.
    """
    sizes = {r.part: r["count"] for r in keys.groupBy(_part().alias("part")).count().collect()}  # KEY_PARTS at most
    events = sum(sizes.values())
    files = files_of(events)
    for n in range(min(STREAMS, files // SHARE_FILES, len(sizes)), 1, -1):
        parts: list[list[int]] = [[] for _ in range(n)]
        loads = [0] * n
        for part in sorted(sizes, key=lambda p: (-sizes[p], p)):
            least = loads.index(min(loads))
            parts[least].append(part)
            loads[least] += sizes[part]
        if min(loads) * files >= SHARE_FILES * events:
            break
    else:
        return [(sorted(sizes), files)]
    counts = [load * files // events for load in loads]
    for k in sorted(range(n), key=lambda k: (-(loads[k] * files % events), k))[: files - sum(counts)]:
        counts[k] += 1
    return list(zip(parts, counts))


def replay_shares(events: DataFrame, path: str, shares: list[tuple[list[int], int]]) -> list[str]:
    """Replays each of the :func:`key_shares` to a folder of its own, as a topic keeps its partitions: all events of a key lie in one, in dropoff order. Gives the folders."""
    spark, staged = events.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    of_part = [0] * KEY_PARTS
    for k, (parts, _) in enumerate(shares):
        for part in parts:
            of_part[part] = k
    dealt = events.select("key", "value", "dropoff_ts", F.get(F.lit(of_part), _part()).alias("share"))
    dealt.write.option("compression", "zstd").partitionBy("share").parquet(staged)
    folders = [f"{path}/share-{k}" for k in range(len(shares))]
    with ThreadPoolExecutor(LISTERS) as replays:
        list(replays.map(lambda k: replay_stream(spark.read.parquet(f"{staged}/share={k}"), folders[k], shares[k][1]), range(len(shares))))
    fs, of = file_system(spark, path)
    fs.delete(of(staged), True)
    return folders
