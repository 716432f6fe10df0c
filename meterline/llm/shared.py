"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which driver and
executors share, so that a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.sources.folders import scratch

#: Text of a batch, for which a task holds numbers for each character.
BATCH_BYTES = 1 << 20
#: Blocks are shuffled, so they are compressed well.
ZSTD_LEVEL = 5


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a table in the shared folder; the plan after it starts from those files."""
    path = scratch(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of all documents; a null text is an empty one."""
    return whole_texts(table(spark, sf_dir, "documents"))


def whole_texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema that Spark gives a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the text gathered passes ``size`` bytes; long texts stay whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, for workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def as_bytes(columns: dict[str, pa.Array]) -> bytes:
    """Arrow columns, compressed."""
    sink = pa.BufferOutputStream()
    rows = pa.record_batch(columns)
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def as_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block long, chunk binary): the documents as compressed Arrow blocks of at most about ``block_bytes`` of text, written once.

    Work that needs something looked up for all words of a text asks once for each distinct word of a block, and meets
    the answers in a cogroup by block; no table of all words is ever broadcast. As the blocks are
    written, a retried task finds the same documents in them as the one that asked.
    """

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))
        parts, held = [], 0

        def block() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, parts[0].schema, options=options) as w:
                for part in parts:
                    w.write_batch(part)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], ["chunk"])

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if parts and held + size > block_bytes:
                    yield block()
                    held = 0
                parts.append(part)
                held += size
        if parts:
            yield block()
        release()

    return written(docs.mapInArrow(pack, "chunk binary").select(F.monotonically_increasing_id().alias("block"), "chunk"), "blocks", compression="uncompressed")


def unpack(chunks: pa.Table | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The documents of blocks, in batches of about ``BATCH_BYTES`` of text."""
    release()
    for chunk in chunks:
        for batch in pa.ipc.open_stream(pa.py_buffer(chunk.as_py())):
            yield from slices(batch, "text", BATCH_BYTES)

