"""Quality rules: gradient-boosted trees over document statistics, behind fixed base rules.

Statistics of every whole text are worked out once and written. Trees are fitted on a
bounded sample of labelled rows, then flattened into arrays of nodes, with which tasks score
whole batches at once. On chosen statistics the score can only fall as they rise.

Defined results: a null or empty text has no words and fails the base rules; repeated rows each get
the same verdict; labels that are null are not used, and with fewer than two kinds of label
the base rules alone decide; an empty table gives an empty one; columns other than ``doc_id`` and ``text`` are ignored. Texts of any length are
counted whole, in time that grows with their words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from meterline.llm.shared import arrow_schema, slices, table, whole_texts, written

#: At most so many labelled rows are fitted on, those with the smallest hash of their doc_id.
SAMPLE_ROWS = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_stops", "n_most_common", "n_chars"]
#: Statistics in the order of the model's columns, and the sign that the score's slope may have (0: any).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1,
    "digit_share": 0, "marks_per_word": -1, "stops_per_word": 0, "most_common_share": -1, "words_per_line": 0, "space_share": 0,
}


def _repeats(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    hashed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    # equal windows have equal hashes; of equal hashes, the words themselves decide
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    held: dict[bytes, int] = {}
    for at in np.flatnonzero(twice).tolist():
        key = ids[at : at + WINDOW].tobytes()
        held[key] = held.get(key, 0) + 1
    inside = np.zeros(len(words) + 1, np.int64)
    for at in np.flatnonzero(twice).tolist():
        if held[ids[at : at + WINDOW].tobytes()] > 1:
            inside[at] += 1
            inside[at + WINDOW] -= 1
    return int((np.cumsum(inside) > 0).sum())


_UPPER, _DIGITS, _MARKS, _STOPS = (bytes(range(65, 91)), b"0123456789", b"!?;:", b".")


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def statistics_of(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0,) * (len(COUNTS) - 1) + (len(text),)
    joined = b"".join(words)
    lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    # a continuation byte is no character of its own
    word_chars = len(joined) - _count(joined, bytes(range(0x80, 0xC0)))
    return (
        len(words), word_chars, _count(data, SYMBOLS), len(lines) - len(set(lines)), _repeats(words), len(lines), len(counts),
        _count(data, _UPPER), _count(data, _DIGITS), _count(data, _MARKS), _count(data, _STOPS), max(counts.values()), len(text),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and COUNTS of every document, and base_failed."""
    ddl = "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = arrow_schema(ddl)

    def work(batches):
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                rows = [statistics_of(t) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), *(pa.array(c, pa.int64()) for c in zip(*rows))], schema=schema)

    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, ddl)
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from COUNTS, row by row."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_marks"] / words, c["n_stops"] / words, c["n_most_common"] / words, c["n_words"] / lines, 1 - c["word_chars"] / np.maximum(c["n_chars"], 1),
    ])


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: a leaf has feature -1; children are node numbers."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at]))
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, slopes: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least_rows: int = 8, ridge: float = 1.0) -> Trees:
    """Boosts trees on logistic loss over quantile bins. A split on a statistic with a
    slope must order its children's values by it, and bounds both sides by their middle.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    nodes: list[list] = []
    roots = []
    rate_pos = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(rate_pos / (1 - rate_pos)))
    score = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        number = len(nodes)
        nodes.append([-1, 0.0, 0, 0, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least_rows:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gl, hl = (np.cumsum(np.bincount(b, weights=w[rows], minlength=len(e) + 1))[:-1] for w in (g, h))
                gr, hr = total_g - gl, total_h - hl
                vl, vr = (np.clip(-a / (c + ridge), low, high) for a, c in ((gl, hl), (gr, hr)))
                # gain at the clipped values
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + (total_g * value + 0.5 * (total_h + ridge) * value**2)
                ok = (n >= least_rows) & (len(rows) - n >= least_rows)
                if slopes[j]:
                    ok &= slopes[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            go = binned[rows, j] <= k
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[slopes[j]]
            left = grow(rows[go], g, h, level + 1, *bounds[0])
            right = grow(rows[~go], g, h, level + 1, *bounds[1])
            nodes[number][:4] = [j, float(edges[j][k]), left, right]
        return number

    def as_trees() -> Trees:
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
        return Trees(feature, threshold, left, right, value, np.array(roots), depth, start)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0))
        one = as_trees()
        one.roots, one.start = np.array([first]), 0.0
        score = score + one.score(x)
    return as_trees()


def sampled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and quality of the labelled rows that are fitted on, at most ``sample_rows``."""
    told = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def train(counted: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Fits on at most ``sample_rows`` labelled rows. The rows' counts, some numbers each, come to the driver; texts do not."""
    rows = sampled(labels, sample_rows)
    # of several texts under one id, that of the smallest hash
    one = counted.groupBy("doc_id").agg(F.min_by(F.struct("base_failed", *COUNTS), "text_hash").alias("first")).select("doc_id", "first.*")
    known = rows.join(one.where("not base_failed"), "doc_id").select("quality", *COUNTS).toPandas()
    if known["quality"].nunique() < 2:
        return None
    known = known.sort_values(list(known.columns))
    return fit(features(known[COUNTS].to_numpy()), known["quality"].to_numpy(float), list(FEATURES.values()))


def verdicts(counted: DataFrame, trees: Trees | None, threshold: float = 0.0) -> DataFrame:
    """Adds ``kept``."""
    if trees is None:
        return counted.withColumn("kept", ~F.col("base_failed"))
    names = counted.columns
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema) + ", kept boolean"
    schema = arrow_schema(ddl)

    def judge(batches):
        for batch in batches:
            counts = np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in COUNTS]) if batch.num_rows else np.empty((0, len(COUNTS)))
            good = trees.score(features(counts)) > threshold
            kept = good & ~batch.column(names.index("base_failed")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], schema=schema)

    return counted.mapInArrow(judge, ddl)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, COUNTS, base_failed and kept of every document."""
    counted = written(statistics(whole_texts(docs)), "statistics")
    return verdicts(counted, train(counted, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`rate` keeps, with all their columns.

    The texts of the sampled labels, which are few, are counted first and teach the trees; then one pass counts and judges every row where it lies, so that no text is moved.
    """
    few = sampled(labels).select(F.col("doc_id").alias("told"))
    texts = whole_texts(docs)
    trees = train(written(statistics(texts.join(F.broadcast(few), texts["doc_id"] == F.col("told"), "left_semi")), "statistics"), labels)
    schema = to_arrow_schema(StructType([StructField("row", docs.schema), StructField("kept", BooleanType())]))

    def judge(batches):
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column("row"), "text"), "")
            for some in slices(pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"]), "text", 4 << 20):
                counts = np.array([statistics_of(t) for t in some.column("text").to_pylist()])
                words, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
                kept = (words >= 20) & (100 * repeated <= 30 * words)
                if trees is not None:
                    kept &= trees.score(features(counts)) > 0
                yield pa.RecordBatch.from_arrays([some.column("row").cast(schema.field("row").type), pa.array(kept)], schema=schema)

    return docs.select(F.struct("*").alias("row")).mapInArrow(judge, StructType([StructField("row", docs.schema), StructField("kept", BooleanType())])).where("kept").select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
