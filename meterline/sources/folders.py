"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables that a session has stored, by session, name and the files that they were made from.
_STORED: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a session on one machine gets a folder of its own; a cluster needs the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="meterline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system that a path belongs to, and the constructor of its paths."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def exists(spark: SparkSession, path: str) -> bool:
    fs, of = file_system(spark, path)
    return fs.exists(of(path))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it is absent."""
    fs, of = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(of(path))) if fs.exists(of(path)) else []


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """A digest of the files of a table by their names, bytes and times, and their number."""
    fs, of = file_system(spark, path)
    files, names = fs.listFiles(of(path), True), hashlib.sha256()
    count = 0
    while files.hasNext():
        x = files.next()
        names.update(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}\n".encode())
        count += 1
    return count, names.hexdigest()


def _key(spark: SparkSession, name: str, sources: list[str]) -> tuple:
    return (spark.sparkContext.applicationId, name, *((x, fingerprint(spark, x)) for x in sources))


def stored_once(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives of some tables, written the first time that a session asks for it and read from its files as long as the files of the ``sources`` are the same."""
    key = _key(spark, name, sources)
    path = _STORED.get(key)
    if path is None or not exists(spark, f"{path}/_SUCCESS"):
        path = scratch(spark, name)
        make().write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(path)


def stored_or_made(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of :func:`stored_once` where the session has stored it, else what ``make`` gives, not written: for a caller that goes over it once or twice, that is less than to write and read it."""
    path = _STORED.get(_key(spark, name, sources))
    return spark.read.parquet(path) if path and exists(spark, f"{path}/_SUCCESS") else make()
