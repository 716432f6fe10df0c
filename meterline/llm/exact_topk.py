"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers, floor(scale * x), and are stored in blocks with one row for each
dimension, in 16 bits where they fit. A task holds one block of queries and a slice of the candidate blocks. It adds
up products some dimensions at a time; what the remaining dimensions can add is at most the
product of the remaining norms, and candidates that cannot reach the k-th best score found
are dropped from the columns still to be read. Queries and candidates both come in blocks, so no task,
broadcast or driver holds either side whole.

Defined results: vectors that are null or hold null or non-finite components, and rows without a vec_id, which no result could name, take no part;
vectors are compared with those of their own length only; ties go to the smaller vec_id; a
row is never its own candidate, but another row of the same vec_id is; repeated query rows
each get their own ranks; a query without candidates has no row; integers of any size are compared exactly, and a
score that a long can't hold is an error; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, table, written

#: Vectors of a candidate block, queries of a task, about, and candidate blocks of a task. Each block of candidates is copied
#: once for each ``QUERIES`` queries: what is compared grows with the square of the rows, but what is copied is a few thousand times less.
BLOCK, QUERIES, SLICE = 4096, 8192, 2
#: Partitions that the meetings are dealt over, at most; they hold few bytes and much work, so they are not to be coalesced.
MOST_PARTITIONS = 20_000
#: Dimensions added at a time.
STEP = 8
COLUMNS = "dims int, n int, asks int, uids binary, ids binary, wanted binary, kind string, columns binary"


def store_columns(vectors: DataFrame, is_query: str, scale: int) -> DataFrame:
    """Blocks of integer vectors of one length, one row of ``columns`` for each dimension."""
    schema = arrow_schema(COLUMNS)
    one = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", F.expr(is_query).alias("wanted"), one.alias("v"))

    def pack(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, wanted = np.array(batch.column(0).to_pylist(), np.int64), np.array(batch.column(1).to_pylist(), bool)
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy()[lists.offsets[0].as_py() :]
            begins = np.concatenate([[0], np.cumsum(sizes)])
            uids = at + np.arange(len(ids), dtype=np.int64)
            at += len(ids)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                for k in range(0, len(rows), BLOCK):
                    r = rows[k : k + BLOCK]
                    # whole numbers, which floating point holds exactly
                    columns = np.floor(values[begins[r][None, :] + np.arange(d)[:, None]] * scale)
                    kind = "<i2" if np.abs(columns).max(initial=0) < 2**15 else "<f8"
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((int(d), len(r), int(wanted[r].sum()), uids[r].tobytes(), ids[r].tobytes(), wanted[r].tobytes(), kind, columns.astype(kind).tobytes()), schema)], schema=schema)

    return rows.mapInArrow(pack, COLUMNS)


def _matrix(row: dict) -> np.ndarray:
    """The columns of a stored block, in floating point: dimensions by vectors."""
    return np.frombuffer(row["columns"], row["kind"]).reshape(row["dims"], len(row["ids"]) // 8).astype(np.float64)


def _exact(m: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


def _rest(m: np.ndarray) -> np.ndarray:
    """For each step, the norms of what remains from it on; the last is 0."""
    squares = np.square(m.astype(np.float64))
    sums = [squares[d:].sum(axis=0) for d in range(0, len(m), STEP)] + [np.zeros(m.shape[1])]
    return np.sqrt(np.array(sums)) * (1 + 1e-9)


class Search:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: np.ndarray, uids: np.ndarray, k: int):
        self.q, self.uids, self.k = queries, uids, k
        self.rest = _rest(queries)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in uids]

    def add(self, c: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Meets a candidate block: all queries for the first step, then each with its survivors."""
        dims, k = len(c), self.k
        top = float(np.abs(self.q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dims)
        small = top < 2**52  # floating point is exact below that
        rest = _rest(c)
        q, c = (self.q, c) if small else (_exact(self.q), _exact(c))
        first = q[:STEP].T @ c[:STEP] if dims else np.zeros((len(self.uids), len(ids)))
        # what rounding may take from a bound
        slack = 1 if small else 1 + top * 1e-9
        for i in range(len(self.uids)):
            partial = first[i]
            held = self.best[i]
            if len(held) >= k:
                floor = held[k - 1][0]
            elif len(ids) > 8 * k:
                # scores of the most promising give a first floor; the query's own row may be one
                some = np.argpartition(-partial.astype(np.float64), 4 * k)[: 4 * k]
                some = some[uids[some] != self.uids[i]]
                floor = np.sort((q[:, i] @ c[:, some]).astype(np.float64))[-k]
            else:
                floor = -np.inf
            live = np.flatnonzero((partial.astype(np.float64) + self.rest[1, i] * rest[1] + slack >= floor) & (uids != self.uids[i])) if dims else np.flatnonzero(uids != self.uids[i])
            score = partial[live]
            for s in range(1, -(-dims // STEP)):
                if not len(live):
                    break
                score = score + q[s * STEP : (s + 1) * STEP, i] @ c[s * STEP : (s + 1) * STEP, live]
                keep = score.astype(np.float64) + self.rest[s + 1, i] * rest[s + 1, live] + slack >= floor
                live, score = live[keep], score[keep]
            if len(live):
                order = np.lexsort((uids[live], ids[live], -score.astype(np.float64)))[: k + 8] if small else range(len(live))
                held += [(int(score[j]), int(ids[live[j]]), int(uids[live[j]])) for j in order]
                held.sort(key=lambda x: (-x[0], x[1], x[2]))
                del held[k:]


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; ``vectors`` has vec_id and embedding."""
    stored = written(store_columns(vectors, is_query, scale).withColumn("block", F.monotonically_increasing_id()), "columns")
    seen = stored.agg(F.count("*").alias("blocks"), F.sum("asks").alias("asks")).first()
    slices = max(1, -(-seen["blocks"] // SLICE))
    groups = max(1, -(-(seen["asks"] or 0) // QUERIES))
    query_ddl = "dims int, group int, uids binary, ids binary, kind string, columns binary"
    query_schema = arrow_schema(query_ddl)

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w = np.flatnonzero(np.frombuffer(row["wanted"], bool))
                uids = np.frombuffer(row["uids"], np.int64)
                columns = np.frombuffer(row["columns"], row["kind"]).reshape(row["dims"], len(uids))
                # a block's queries go to one group, those of a block with very many to several
                for at in range(0, len(w), QUERIES):
                    some = w[at : at + QUERIES]
                    group = zlib.crc32(uids[some].tobytes()) % groups
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["dims"], group, uids[some].tobytes(), np.frombuffer(row["ids"], np.int64)[some].tobytes(), row["kind"], columns[:, some].tobytes()), query_schema)], schema=query_schema)

    queries = stored.where("asks > 0").select("dims", "uids", "ids", "wanted", "kind", "columns").mapInArrow(pick, query_ddl)
    queries = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = stored.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found_ddl = "query_uid long, query_id long, vec_id long, uid long, score long"
    found_schema = arrow_schema(found_ddl)

    def search(key, left, right):
        rows = []
        if left.num_rows and right.num_rows:
            some = left.to_pylist()
            q = np.concatenate([_matrix(r) for r in some], axis=1)
            uids, ids = (np.concatenate([np.frombuffer(r[c], np.int64) for r in some]) for c in ("uids", "ids"))
            held = Search(q, uids, k)
            for batch in right.to_batches(max_chunksize=1):
                row = batch.to_pylist()[0]
                held.add(_matrix(row), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64))
            rows = [(int(u), int(i), vec_id, uid, score) for u, i, best in zip(uids, ids, held.best) for score, vec_id, uid in best]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(found_schema)], schema=found_schema)

    parts, key = min(2 * groups * slices, MOST_PARTITIONS), ("dims", "group", "slice")
    sliced = sliced.select(*key, "uids", "ids", "kind", "columns")
    met = queries.repartition(parts, *key).groupBy(*key).cogroup(sliced.repartition(parts, *key).groupBy(*key))
    found = met.applyInArrow(search, found_ddl)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 50 = 0")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.uid AS uid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
