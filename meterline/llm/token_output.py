"""Token ids as Parquet: list columns, dictionary-encoded, with small pages and their index.

Files hold ``doc_id, part, local_start, n_tokens, ids`` in ascending ``doc_id`` order. Ids are
dictionary-encoded 32-bit integers (a vocabulary fits the dictionary page); row groups and
pages are kept small and indexed, so that a reader of some documents or of the counts alone
touches few pages: counts never read ``ids``, and a range of ``doc_id`` skips row groups.

Defined results: a null text is empty and has just the end id; repeated ``doc_id`` values are
kept as rows of their own, ordered by a hash of their text; an empty table gives an empty
one; columns other than ``doc_id`` and ``text`` are ignored. Texts of any length are encoded whole; one longer than a batch is encoded by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, documents, slices, whole_texts, written
from meterline.llm.tokens import BATCH_BYTES, encoder

STORED = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Bytes of a row group, of a page and of a dictionary page, and rows of a page.
LAYOUT = {"parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.dictionary.page.size": 1 << 20, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": "true"}


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, name: str = "tokens") -> DataFrame:
    """Encodes all documents and writes them; returns the table read back from the files."""
    docs = whole_texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = arrow_schema(STORED)

    def encode(batches):
        from pyspark import TaskContext

        part, at, encode_batch = TaskContext.get().partitionId(), 0, encoder(tokenizer, True).encode_batch
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                ids, counts = encode_batch(some.column("text"), end_id)
                ends = np.cumsum(counts)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32)))
                starts = pa.array(at + ends - counts)
                at += len(ids)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), starts, pa.array(counts), column.cast(schema.field("ids").type)], schema=schema)

    return written(ordered.select("doc_id", "text").mapInArrow(encode, STORED), name, compression="snappy", **LAYOUT)


#: Files whose totals are broadcast; of more, totals are joined by sorting.
MOST_TOTALS = 1_000_000


def with_starts(stored: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before. Only one total for each file is summed up; ids are not read for it. Totals of up to ``MOST_TOTALS`` files, 12 bytes each, are broadcast."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("part", before.alias("base"))
    side = F.broadcast(base) if len(stored.inputFiles()) <= MOST_TOTALS else base
    return stored.join(side, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_tokens(stored: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ``low <= doc_id < high``; the bounds reach the files' statistics and page index."""
    if low is not None:
        stored = stored.where(F.col("doc_id") >= low)
    if high is not None:
        stored = stored.where(F.col("doc_id") < high)
    return stored


def ids_crc32(tokens: DataFrame, keep: str) -> DataFrame:
    """The columns of ``keep`` and ``ids_crc32``, the crc32 of ids as little-endian 32-bit integers."""
    ddl = f"{keep}, ids_crc32 long"
    names = [x.split()[0] for x in keep.split(", ")]
    schema = arrow_schema(ddl)

    def digest(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            offsets = ids.offsets.to_pylist()
            values = memoryview(ids.values.cast(pa.int32()).to_numpy(zero_copy_only=False)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], schema=schema)

    return tokens.select(*names, "ids").mapInArrow(digest, ddl)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stored = write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return ids_crc32(with_starts(read_tokens(stored)), "doc_id long, start long, n_tokens long")
