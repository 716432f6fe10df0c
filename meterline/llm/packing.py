"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences already.
The others are packed best-fit decreasing inside each partition; bins with at most
``slack`` free tokens are emitted, the rest become items of the next round, in which
``FAN_IN`` partitions meet in one, until one partition is left. A round works on
at most about ``ITEMS`` items a task: while more are left, as many partitions remain, and
packing ends when a round no longer removes bins.

Defined results: a null text is empty and is a piece of the end id alone; repeated rows are packed
each on its own; an empty table gives an empty one; columns other than ``doc_id`` and ``text`` are ignored. Texts of any length are encoded
whole, one at a time where they are longer than a batch, and cut into as many pieces as they need.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, documents, slices, whole_texts, written
from meterline.llm.tokens import BATCH_BYTES, encoder

CAPACITY = 2048
ITEMS = 50_000
FAN_IN = 8
#: A bin with so few free tokens is nearly full.
SLACK = 4
PIECES = "doc_id long, piece int, start long, length int, ids binary"
BINS = "closed boolean, size int, uids array<long>, lengths array<int>"
#: Bins with their members' places.
PLACES = "sequence_id long, uid long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document and its end id; ``ids`` are little-endian 32-bit."""
    schema = arrow_schema(PIECES)

    def cut(batches):
        encode_batch = encoder(tokenizer, False).encode_batch
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                ids, counts = encode_batch(some.column("text"), end_id)
                pieces = -(-counts // capacity)
                place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lengths = np.minimum(np.repeat(counts, pieces) - place * capacity, capacity)
                bounds = 4 * np.concatenate([[0], np.cumsum(lengths)])
                binary = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                columns = [some.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), pieces))), pa.array(place), pa.array(place * capacity), pa.array(lengths), binary]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return whole_texts(docs).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, largest first, goes to the fullest bin that can hold it. Free space is a small integer, so the open bins are kept by it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    frees: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        k = bisect_left(frees, sizes[i])
        if k == len(frees):
            b, free = len(bins), capacity
            bins.append([])
        else:
            free = frees[k]
            b = by_free[free].pop()
            if not by_free[free]:
                frees.pop(k)
        bins[b].append(i)
        if left := free - sizes[i]:
            if not by_free[left]:
                insort(frees, left)
            by_free[left].append(b)
    return bins


def pack_layout(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """(uid, length) to (uid, sequence_id, offset): gapless places in as few sequences as the rounds find."""
    spark = items.sparkSession
    schema = arrow_schema(BINS)
    count = items.where(F.col("length") < capacity).count()
    state = items.select((F.col("length") >= capacity).alias("closed"), F.col("length").cast("int").alias("size"), F.array("uid").alias("uids"), F.array(F.col("length").cast("int")).alias("lengths"))
    parts, done = max(1, -(-count // ITEMS)), [state.where("closed")]
    state = state.where("not closed")
    while True:
        last = parts == 1

        def pack(group: pa.Table) -> pa.Table:  # noqa: B023  (the table is written before the next turn)
            sizes, uids, lengths = (group.column(c).to_pylist() for c in ("size", "uids", "lengths"))
            rows = []
            for members in best_fit(sizes, capacity):
                size = sum(sizes[i] for i in members)
                rows.append((last or capacity - size <= slack, size, [u for i in members for u in uids[i]], [n for i in members for n in lengths[i]]))
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        dealt = state.withColumn("part", F.pmod(F.xxhash64(F.col("uids")[0]), F.lit(parts)))
        packed = written(dealt.groupBy("part").applyInArrow(pack, BINS), "packed")
        done.append(packed.where("closed"))
        state = packed.where("not closed")
        if last:
            break
        left = state.count()
        if left > 0.98 * count and parts <= -(-left // ITEMS):
            done.append(state)
            break
        parts = max(-(-left // ITEMS), parts // FAN_IN, 1)
        count = left
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    bins = written(bins.select(F.monotonically_increasing_id().alias("sequence_id"), "uids", "lengths"), "bins")
    places_schema = arrow_schema(PLACES)

    def place(batches):
        for batch in batches:
            ids, uids, lengths = batch.columns
            n = np.diff(uids.offsets.to_numpy())
            sizes = lengths.flatten().to_numpy().astype(np.int64)
            before = np.cumsum(sizes) - sizes
            first = np.repeat(before[np.minimum(np.cumsum(n) - n, max(len(before) - 1, 0))], n) if len(before) else before
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(), n)), uids.flatten(), pa.array(before - first)], schema=places_schema)

    return bins.mapInArrow(place, PLACES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The pieces (with ``uid`` and ``ids``), written once, and their layout by ``uid``."""
    pieces = token_pieces(docs, tokenizer, capacity=capacity).withColumn("uid", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    return pieces, pack_layout(pieces.select("uid", "length"), capacity)


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces, layout = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("uid", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return digest.join(layout, "uid").drop("uid")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(documents(spark, sf_dir))
