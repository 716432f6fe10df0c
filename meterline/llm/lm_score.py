"""Language-model scores: prediction by partial matching over bytes, and a unigram baseline.

The byte-context trie of the training documents is held as tables of (context, symbol,
count), one for each order; every order's counts are sums of the deepest order's, so each
symbol seen after a context was also seen after its suffixes. A symbol's probability comes
from the longest context that was seen with it: escapes are estimated by half the number of
distinct symbols (method D), and symbols of the context escaped from are excluded.

Texts are lower-cased (A-Z) and end in one end symbol. Each block of documents asks once
for each distinct (context, symbol) and word it holds; probabilities are worked out once
for each distinct one of all blocks, by joins down the orders; the answers meet the block's
documents in a cogroup. No model is broadcast or collected, whatever its size.

Defined results: a null text is empty and has the end symbol alone; a null ``doc_id`` counts as the text
'' in the fold; repeated rows are counted and scored each; without training documents all symbols are
equally likely; an empty table gives an empty one; columns other than ``doc_id`` and ``text`` are ignored. Texts of any length are scored
whole; one larger than a block is a block of its own, whose task holds 8 bytes for each of its bytes.

A block asks for a gram or word once, so that of the rows that ask, those of one key are no more than the blocks: about one in the hundred thousands of
distinct grams of a block, less than a task takes anyway. Joins on grams and words need no split.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, as_bytes, as_table, blocks, documents, release, unpack, whole_texts, written

#: Bytes of context. A context and its symbol, ORDER + 1 bytes, fit a long.
ORDER = 5
#: A byte that UTF-8 never holds pads the start of a text and is its end symbol.
END = 0xFF
#: Text of a block; distinct grams are gathered chunk by chunk, so that memory follows their number.
BLOCK_BYTES = 32 << 20
#: Answers that a task gathers before it writes them.
HELD_ANSWERS = 1_000_000
#: Grams of a block's chunks that are gathered before they join those already summed.
HELD_GRAMS = 1_000_000
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every (context, symbol) of the lower-cased texts as a number, and where each text's begin."""
    pad = bytes([END]) * ORDER
    joined = np.frombuffer(pad + pad.join(t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    all_grams = np.zeros(len(joined) - ORDER, np.int64)
    for k in range(ORDER + 1):
        all_grams = (all_grams << 8) | joined[k : len(joined) - ORDER + k]
    # of the joined texts, the places whose symbol is pad are dropped
    keep = np.ones(len(all_grams), bool)
    for k in range(ORDER):
        keep[(starts[1:] + ORDER * np.arange(len(texts) - 1)) + k] = False
    return all_grams[keep], starts


def _lower(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() for t in batch.column("text").to_pylist()]


class GramTable:
    """Numbers to values by an open-addressed table, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._shift = np.uint64(64 - max(8, int(len(keys) * 2).bit_length()))
        n = 1 << (64 - int(self._shift))
        self._mask = n - 1
        self._keys = np.full(n, -1, np.int64)
        self._values = np.zeros(n, np.float64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[left[free]]
            placed = self._keys[at] == keys[left]
            self._values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self._values[at]
        left = np.flatnonzero(self._keys[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & self._mask
            here = self._keys[at]
            if (here == -1).any():
                raise KeyError("a gram of the block was not asked for")
            found = here == keys[left]
            out[left[found]] = self._values[at[found]]
            left, at = left[~found], at[~found]
        return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    all_keys = np.concatenate([np.empty(0, np.int64), *keys])
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], np.concatenate([np.empty(0, np.int64), *counts])[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])[: len(all_keys)])
    return all_keys[first], np.add.reduceat(all_counts, first).astype(np.int64) if len(first) else all_counts


def ask_grams(dealt: DataFrame, folds: int, fold: int) -> DataFrame:
    """(block, gram, n): each distinct gram of a block, with its count in training documents."""
    ddl = "block long, gram long, n long"
    schema = arrow_schema(ddl)

    def ask(block: int, chunk: pa.Array) -> pa.RecordBatch:
        keys, counts, pending = [], [], 0
        for batch in unpack(chunk):
            texts, out = _lower(batch), [held_out(i, folds, fold) for i in batch.column("doc_id").to_pylist()]
            for counted in (True, False):
                if some := [t for t, o in zip(texts, out) if o != counted]:
                    found, n = np.unique(grams(some)[0], return_counts=True)
                    keys.append(found)
                    counts.append(n if counted else np.zeros(len(n), np.int64))
                    pending += len(found)
            if pending > HELD_GRAMS:
                merged = summed(keys, counts)
                keys, counts, pending = [merged[0]], [merged[1]], 0
        found, sums = summed(keys, counts)
        del keys, counts
        told = pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int64)), pa.array(found), pa.array(sums)], schema=schema)
        del found, sums
        release()
        return told

    return dealt.mapInArrow(lambda batches: (ask(k.as_py(), c) for k, c in _each(batches)), ddl)


def _each(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i], batch.column(1).slice(i, 1)


def ask_words(dealt: DataFrame, folds: int, fold: int) -> DataFrame:
    """(block, word, n): each distinct word of a block, with its count in training documents."""
    ddl = "block long, word binary, n long"
    schema = arrow_schema(ddl)

    def ask(block: int, chunk: pa.Array) -> pa.RecordBatch:
        counts: Counter[bytes] = Counter()
        seen: set[bytes] = set()
        for batch in unpack(chunk):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _lower(batch)):
                (seen if held_out(doc_id, folds, fold) else counts).update(text.split())
        for w in seen:
            counts.setdefault(w, 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), block, np.int64)), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    return dealt.mapInArrow(lambda batches: (ask(k.as_py(), c) for k, c in _each(batches)), ddl)


def trie(counts: DataFrame) -> list[DataFrame]:
    """For each order from 0, (context, symbol, n, total, distinct_symbols), from the deepest order's (gram, n > 0)."""
    orders = []
    for k in range(ORDER + 1):
        kept = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        level = counts.groupBy(kept.alias("gram")).agg(F.sum("n").alias("n")) if k < ORDER else counts
        of = Window.partitionBy("context")
        level = level.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
        orders.append(level.withColumn("total", F.sum("n").over(of)).withColumn("distinct_symbols", F.count("*").over(of)))
    return orders


def escapes(orders: list[DataFrame], k: int) -> DataFrame:
    """For each context of order k: total, distinct_symbols, and ``excluded``, the count that its symbols have after its suffix."""
    level = orders[k]
    if k == 0:
        return level.groupBy("context").agg(F.first("total").alias("total"), F.first("distinct_symbols").alias("distinct_symbols"), F.lit(0).cast("long").alias("excluded"))
    shorter = orders[k - 1].select(F.col("context").alias("suffix"), F.col("symbol").alias("s"), F.col("n").alias("m"))
    if k == 1:
        shorter = F.broadcast(shorter)  # at most 256 rows
    suffix = F.col("context").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))
    both = level.join(shorter, (suffix == F.col("suffix")) & (F.col("symbol") == F.col("s")))
    return both.groupBy("context").agg(F.first("total").alias("total"), F.first("distinct_symbols").alias("distinct_symbols"), F.sum("m").alias("excluded"))


def gram_costs(asked: DataFrame) -> DataFrame:
    """(gram, cost): minus the log10 probability of each asked gram's symbol after its context."""
    all_grams = written(asked.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    orders = [written(level, f"order{k}") for k, level in enumerate(trie(all_grams.where("n > 0")))]
    known = orders[ORDER].select(F.shiftleft("context", 8).bitwiseOR(F.col("symbol")).alias("gram"), F.log10(2 * F.col("total") / (2 * F.col("n") - 1)).alias("cost"))
    # what was never seen whole goes down the orders
    rows = all_grams.where("n = 0").select("gram", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_symbols"))
    done = known
    for k in range(ORDER, -1, -1):
        mask = F.lit((1 << (8 * k)) - 1)
        here = escapes(orders, k).select("context", F.col("total"), F.col("distinct_symbols"), "excluded")
        found = orders[k].select(F.col("context").alias("c"), F.col("symbol").alias("s"), "n")
        if k < 2:
            here, found = F.broadcast(here), F.broadcast(found)  # at most 256 and 65,536 rows
        rows = rows.withColumn("context", F.shiftright("gram", 8).bitwiseAND(mask)).join(here, "context", "left")
        if k < ORDER:
            rows = rows.join(found, (F.col("context") == F.col("c")) & (F.col("gram").bitwiseAND(F.lit(255)).cast("int") == F.col("s")), "left").drop("c", "s")
        else:
            rows = rows.withColumn("n", F.lit(None).cast("long"))
        total, symbols = F.col("total") - F.col("gone"), F.col("distinct_symbols") - F.col("gone_symbols")
        seen = F.col("total").isNotNull()
        step = F.when(F.col("n").isNotNull(), F.log10(2 * total / (2 * F.col("n") - 1))).when(seen & (symbols > 0), F.log10(2 * total / F.greatest(symbols, F.lit(1)))).otherwise(F.lit(0.0))
        rows = rows.select("gram", "n", (F.col("cost") + step).alias("cost"), F.when(seen, F.col("excluded")).otherwise(F.lit(0)).alias("gone"), F.when(seen, F.col("distinct_symbols")).otherwise(F.lit(0)).alias("gone_symbols"))
        rows = written(rows, f"down{k}")
        done = done.unionByName(rows.where("n is not null").select("gram", "cost"))
        rows = rows.where("n is null").drop("n")
    last = F.log10(F.greatest(F.lit(256) - F.col("gone_symbols"), F.lit(1)).cast("double"))
    return done.unionByName(rows.select("gram", (F.col("cost") + last).alias("cost")))


def by_block(answers: DataFrame) -> DataFrame:
    """(asked_by, grams, words): answers to a block in a few rows, compressed; grams as steps from one to the next, costs by number."""
    ddl = "asked_by long, grams binary, words binary"
    schema = arrow_schema(ddl)

    def pack(batches):
        held, count = [], 0

        def rows() -> pa.RecordBatch:
            told = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("gram", "ascending")])
            held.clear()
            blocks = told["block"].to_numpy()
            found, first = np.unique(blocks, return_index=True)
            out = []
            for block, at, n in zip(found.tolist(), first.tolist(), np.diff(np.append(first, len(blocks))).tolist()):
                part = told.slice(at, n)
                known = n - part["gram"].null_count  # nulls come last
                grams, of_word = part.slice(0, known), part.slice(known)
                steps = np.diff(grams["gram"].to_numpy(), prepend=0) if known else None
                out.append((block, as_bytes({"step": pa.array(steps), "cost": grams["cost"].combine_chunks().dictionary_encode()}) if known else None, as_bytes({"word": of_word["word"].combine_chunks(), "cost": of_word["cost"].combine_chunks()}) if known < n else None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count > HELD_ANSWERS:
                yield rows()
                count = 0
        if count:
            yield rows()
        release()

    return answers.mapInArrow(pack, ddl)


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores every document with what the documents outside ``fold`` teach; see the module's text."""
    docs = whole_texts(docs)
    dealt = blocks(docs, BLOCK_BYTES)
    words = written(ask_words(dealt, folds, fold), "words")
    counts = words.groupBy("word").agg(F.sum("n").alias("c"))
    # the end symbol is a token too, once for each training document
    train = docs.agg(F.sum(F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds != fold, 1).otherwise(0)).alias("ends")).first()["ends"] or 0
    row = counts.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = (row["n"] or 0) + train, row["v"] + (train > 0)
    asked = written(ask_grams(dealt, folds, fold), "asked")
    costs = gram_costs(asked)
    nothing = F.lit(None)
    answers = asked.join(costs, "gram").select("block", "gram", nothing.cast("binary").alias("word"), "cost").unionByName(
        words.join(counts, "word").select("block", nothing.cast("long").alias("gram"), "word", F.col("c").cast("double").alias("cost"))
    )
    schema = arrow_schema(SCORED)

    def answer(key, group, told):
        parts = [as_table(x.as_py()) for x in told["grams"] if x.is_valid]
        table = GramTable(*(np.concatenate([f(t) for t in parts] or [np.empty(0)]).astype(kind) for f, kind in ((lambda t: np.cumsum(t["step"].to_numpy()), np.int64), (lambda t: np.asarray(t["cost"].combine_chunks().dictionary_decode()), np.float64))))
        parts = [as_table(x.as_py()) for x in told["words"] if x.is_valid]
        of_word = pa.concat_tables(parts) if parts else pa.table({"word": pa.array([], pa.binary()), "cost": pa.array([], pa.float64())})
        # few distinct counts: words share their logarithms
        some, which = np.unique(of_word["cost"].to_numpy(), return_inverse=True)
        shared = np.log10(some + 1).tolist()
        logs = dict(zip(of_word["word"].to_pylist(), map(shared.__getitem__, which.tolist())))
        del told, of_word, parts, some, which
        least = -math.log10(total + vocabulary + 1)
        end_log = math.log10(train + 1)
        rows = []
        for batch in unpack(group["chunk"]):
            texts, doc_ids = _lower(batch), batch.column("doc_id").to_pylist()
            keys, starts = grams(texts)
            sums = np.add.reduceat(table[keys], starts)
            for doc_id, text, cost in zip(doc_ids, texts, sums.tolist()):
                tokens = text.split()
                values = [logs[w] for w in tokens]
                n = len(tokens) + 1
                known = len(tokens) - values.count(0.0) + (train > 0)
                rows.append((doc_id, held_out(doc_id, folds, fold), n, known, total, math.fsum(values) + end_log + n * least, -cost))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return dealt.groupBy("block").cogroup(by_block(answers).groupBy("asked_by")).applyInArrow(answer, SCORED)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
