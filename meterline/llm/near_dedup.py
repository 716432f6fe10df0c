"""MinHash near-duplicate groups.

A document's set holds its distinct word shingles. Sets that are equal form a class with one
node. Nodes get minima of many universal hashes, cut into bands; nodes that share a band
are candidates. A first round tests each node of a band against the band's smallest node; a
second tests what the first left in different components, so that no two candidates stay
apart untested. Every link is verified, first on signatures, then on full sets. Components
come from alternating large-star and small-star.

No step gathers a band or component into one task or emits all of its pairs: bands are
joined on their smallest node, clusters of components are cut into blocks of about ``MEMBERS`` nodes
that meet two by two, all of them or band by band.

Defined results: a null, empty or wordless text has an empty set and is a component of its own; a text with
fewer words than a shingle is one shingle; repeated rows of one ``doc_id`` each get a row and
share a component if their sets are equal or linked; a null ``doc_id`` is never the name of
a component unless alone; an empty table gives an empty one; columns other than ``doc_id`` and ``text`` are ignored. Texts of any length are
taken whole: a set takes 8 bytes for each distinct shingle of one text at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, documents, whole_texts, written

#: Bands and rows of a band: at a similarity of 0.8, one pair in 10,000 shares no band.
BANDS, ROWS = 50, 8
#: Nodes that meet in one task, on either side.
MEMBERS = 1024
#: Agreeing minima that a pair of similarity 0.8 reaches but for odds of about one in 10 million.
MARGIN = 0.11

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, width: int):
        self._width = width
        self._ids: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        ids = self._ids
        if len(ids) > 1_000_000:
            ids.clear()
        try:
            h = np.array([ids[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in ids:
                    ids[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            h = np.array([ids[w] for w in words], np.uint64)
        width = min(self._width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mix(out * _ODD + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full((BANDS * ROWS, 1), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (_A * x[i : i + 2048] + _B).min(axis=1, keepdims=True))
    return out[:, 0]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _ODD + rows[:, k])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set (null if empty) and band keys, for every row."""
    ddl = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"
    schema = arrow_schema(ddl)

    def work(batches):
        shingles = Shingler(width)
        for batch in batches:
            ids, hashes, texts = (batch.column(k).to_pylist() for k in range(3))
            for at in range(0, len(texts), 512):
                counts, digests, bands = [], [], []
                for text in texts[at : at + 512]:
                    s = shingles(text)
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(band_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[at : at + 512], hashes[at : at + 512], counts, digests, bands), schema)], schema=schema)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(work, ddl)


def node_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, sig (a byte of each minimum) and shingles (sorted 64-bit hashes), of rows with a node."""
    ddl = "node long, sig binary, shingles binary"
    schema = arrow_schema(ddl)

    def work(batches):
        shingles = Shingler(width)
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                sets = [shingles(t) for t in texts[at : at + 256]]
                sigs = [signature(s).astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 256], pa.int64()), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return docs.select("node", "text").mapInArrow(work, ddl)


def _similar(sig_a: bytes, a: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` are linked with ``a``: by size, then signature, then the full sets."""
    sizes = np.array([len(s) for s in sets])
    ok = np.flatnonzero(100 * np.minimum(sizes, len(a)) >= percent * np.maximum(sizes, len(a)))
    if len(ok):
        agree = (sigs[ok] == np.frombuffer(sig_a, np.uint8)).mean(axis=1)
        ok = ok[agree >= percent / 100 - MARGIN]
    if not len(ok):
        return ok
    values = np.concatenate([sets[i] for i in ok])
    place = np.minimum(np.searchsorted(a, values), len(a) - 1)
    both = np.add.reduceat((a[place] == values).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[ok])[:-1]]))
    return ok[100 * both >= percent * (len(a) + sizes[ok] - both)]


#: Rows of a key that one task takes in :func:`spread`, at least, and keys with more than that, at most.
HOT_ROWS, MOST_HOT = 1000, 10_000


def spread(many: DataFrame, one: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has one row for each ``key``. A key with a large part of ``many`` is dealt over several tasks by a hash of ``by``, and its row of ``one`` is copied to each.

    What a task takes of a key is a ``MOST_HOT``-th of all rows or ``HOT_ROWS``, so fewer than ``MOST_HOT`` keys can have more: their list is small whatever the input, and is broadcast. ``counted`` has the keys of ``many`` where that is cheaper to count.
    """
    counted = many if counted is None else counted
    most = max(HOT_ROWS, counted.count() // MOST_HOT)
    hot = F.broadcast(counted.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col(key).alias("hot"), F.ceil(F.col("n") / most).cast("int").alias("parts")))
    left = many.join(hot, F.col(key) == F.col("hot"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0)))
    right = one.join(hot, F.col(key) == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return left.drop("hot", "parts").join(right.drop("hot", "parts"), [key, "salt"]).drop("salt")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    schema = arrow_schema("a long, b long")

    def work(batches):
        for batch in batches:
            a, b, sig_a, sig_b, set_a, set_b = (batch.column(k).to_pylist() for k in range(6))
            keep = [i for i in range(len(a)) if len(_similar(sig_a[i], np.frombuffer(set_a[i], np.uint64), np.frombuffer(sig_b[i], np.uint8)[None, :], [np.frombuffer(set_b[i], np.uint64)], percent))]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], schema=schema)

    left = sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("shingles").alias("set_b"))
    # many nodes may have one leader
    both = spread(pairs.join(left, "a"), right, "b", "a", pairs).select("a", "b", "sig_a", "sig_b", "set_a", "set_b")
    return both.mapInArrow(work, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for all ends of (a, b) edges, component being the smallest node reachable. Alternates
    large-star and small-star; each is an aggregate to every node's smallest neighbour and
    a join back, so that a hub is never gathered.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = written(edges, name), None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: every larger neighbour of a hangs on a's smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a and its smaller neighbours hang on a's smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def dealt(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of ``members`` (band, node) in bands with several components of ``labels``, in the groups in which they meet.

    Components that share bands form a cluster. A cluster's nodes meet all together or band by band, whichever
    moves fewer sets; ``band`` is 0 if together. Of a group, ``largest`` is the component with most nodes,
    ``row_parts`` the number of blocks for all nodes and ``ask_parts`` that for the nodes of other components.
    """
    held = members.join(labels, "node")
    split = held.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "low")
    held = held.join(split, "band")
    met = components(held.select(F.col("component").alias("a"), F.col("low").alias("b")), "clusters").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    held = written(held.join(met, "component", "left").select(F.coalesce("cluster", "component").alias("cluster"), "band", "component", "node"), "clusters")
    together = held.select("cluster", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("band"), "component", "node").distinct()
    nodes = together.unionByName(held.withColumn("whole", F.lit(False)))
    group = ["cluster", "whole", "band"]
    sizes = nodes.groupBy(*group, "component").agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("most"))
    others = F.col("size") - F.col("most.n")

    def parts(n):
        return F.greatest(F.lit(1), F.ceil(n / MEMBERS)).cast("int")

    sizes = sizes.select(*group, "size", others.alias("others"), parts(F.col("size")).alias("row_parts"), parts(others).alias("ask_parts"), F.col("most.component").alias("largest"))
    copies = F.col("size") * F.col("ask_parts") + F.col("others") * F.col("row_parts")
    cheaper = sizes.groupBy("cluster").agg((F.sum(F.when(F.col("whole"), copies)) <= F.sum(F.when(~F.col("whole"), copies))).alias("whole"))
    return nodes.join(sizes.join(cheaper, ["cluster", "whole"]).drop("size", "others"), group).drop("whole")


def sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who asks and who is asked, by cell (cluster, band, ask, row): each block of a group's nodes outside its
    largest component meets each block of all its nodes. Blocks have about ``MEMBERS`` nodes.
    """
    own = [c for c in nodes.columns if c not in ("largest", "row_parts", "ask_parts")]
    ask, row = (F.pmod(F.xxhash64("node"), F.col(f"{k}_parts")).cast("int").alias(k) for k in ("ask", "row"))
    every_ask, every_row = (F.explode(F.sequence(F.lit(0), F.col(f"{k}_parts") - 1)).alias(k) for k in ("ask", "row"))
    return nodes.where("component <> largest").select(*(F.col(c).alias(c) for c in own), ask, every_row), nodes.select(*own, row, every_ask)


def untested(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of ``labels`` whose nodes share a band; ``members`` has (band, node).

    Each node that asks gives one link for each other component found in a block.
    """
    asks, rows = sides(dealt(members, labels).join(sets, "node"))
    schema = arrow_schema("a long, b long")

    def compare(key, left, right):
        a, b = [], []
        if left.num_rows and right.num_rows:
            nodes, of = (right[c].to_numpy() for c in ("node", "component"))
            sigs = np.stack([np.frombuffer(x, np.uint8) for x in right["sig"].to_pylist()])
            held = [np.frombuffer(x, np.uint64) for x in right["shingles"].to_pylist()]
            for node, own, sig, x in zip(*(left[c].to_pylist() for c in ("node", "component", "sig", "shingles"))):
                hits = _similar(sig, np.frombuffer(x, np.uint64), sigs, held, percent)
                hits = hits[of[hits] != own]
                hits = hits[np.unique(of[hits], return_index=True)[1]]
                a += [node] * len(hits)
                b += nodes[hits].tolist()
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    cell = ("cluster", "band", "ask", "row")
    return asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (null for an empty set) and component_id, for every row of ``docs``; documents with
    100 * intersection >= percent * union of their shingle sets are linked.
    """
    docs = whole_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    prints = written(fingerprints(docs, width), "prints")
    classes = prints.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("smallest"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "smallest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")), "classes")
    # a row of each class has its bands
    nodes = prints.join(classes.select("node", "digest"), "digest").groupBy("node").agg(F.first("bands").alias("bands"))
    members = nodes.select("node", F.explode("bands").alias("band"))
    least = members.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = written(members.join(least, "band").select("band", "node", "leader"), "members")
    stars = written(members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    wanted = members.select("node").distinct().join(classes, "node").select("node", "doc_id", "text_hash")
    # repeated rows of one text have one set; one row of it is enough
    picked = docs.join(wanted.hint("shuffle_hash"), [docs["doc_id"].eqNullSafe(wanted["doc_id"]), docs["text_hash"] == wanted["text_hash"]]).select("node", "text").dropDuplicates(["node"])
    sets = written(node_sets(picked, width), "sets")
    first = written(verified(stars, sets, percent), "links")
    labels = sets.select("node").join(components(first), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labels = written(labels, "labels")
    more = written(untested(members.select("band", "node"), labels, sets, percent), "links")
    found = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # components are named by the smallest doc_id of their classes
    of_class = written(classes.join(found, "node", "left").select("digest", "smallest", F.coalesce("component", "node").alias("component")), "named")
    names = of_class.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = spread(of_class, names, "component", "digest").select("digest", "component", "component_id")
    rows = prints.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept, for every row of ``docs``."""
    return grouped(docs, width, percent).select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2).select("doc_id", "n_shingles", "component_id", "kept")
