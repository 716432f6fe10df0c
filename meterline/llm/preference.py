"""A quality classifier by pairwise preferences: a Bradley-Terry model of document statistics.

That one document is better than another has the probability ``sigmoid(s(better) - s(worse))``. The score ``s`` is linear in
terms of the documents' statistics; its weights are learned by logistic loss on the differences of terms between preferred and other documents.
Each labelled row meets ``ROUNDS`` rows of the other label, so that pairs grow with the rows and not with their square. The
threshold is a quantile of the training rows' scores, near their share of bad labels; scores are moved into 0 to 1 so that it becomes ``CUT``.

Defined results: a null or empty text has statistics of zero and gets a score too; labels that are null or of a null doc_id are not
used, of several labels of one doc_id the highest is, and of several texts that with the smallest hash; repeated rows each get the same score;
with fewer than two kinds of label every score is 0.5; a null doc_id counts as held out; an empty table gives an empty one; columns other
than ``doc_id`` and ``text`` are ignored. Texts of any length are taken whole; a task holds some megabytes or one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.quality import COUNTS, features, statistics
from meterline.llm.shared import arrow_schema, table, whole_texts, written

#: At most so many labelled rows are fitted on, those with the smallest hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Rows of the other label that each labelled row is compared with.
ROUNDS = 8
#: Where the threshold comes to lie between 0 and 1.
CUT = 0.3
#: Bounds of hinges, as quantiles of each statistic over all fitted rows.
HINGES = (0.02, 0.1, 0.5, 0.9, 0.98)
RIDGE, STEPS = 1e-3, 30
#: How far, as a share of itself, the quantile of the threshold may lie from the share of bad labels.
NEAR = 0.1
RATED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Preferences:
    """Weights of the terms, and the score that becomes ``CUT``."""

    middle: np.ndarray
    spread: np.ndarray
    bounds: np.ndarray
    weights: np.ndarray
    threshold: float

    def terms(self, x: np.ndarray) -> np.ndarray:
        """Each statistic, standardised and kept within bounds, and how far it lies beyond each of its hinges."""
        z = np.clip((x - self.middle) / self.spread, -10, 10)
        return np.concatenate([z, *(np.maximum(z - b, 0) for b in self.bounds)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` and more where the model's score reaches its threshold."""
        margin = np.clip(self.terms(x) @ self.weights - self.threshold, -500, 500)
        out = 1 / (1 + np.exp(-margin) * (1 - CUT) / CUT)
        return np.where(margin >= 0, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))


def pairs(good: np.ndarray, bad: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs, better and worse: every row is compared ``rounds`` times or more, and no more pairs are made than that takes."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad))
    better = np.concatenate([np.resize(rng.permutation(good), n) for _ in range(rounds)])
    return better, np.concatenate([np.resize(rng.permutation(bad), n) for _ in range(rounds)])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Preferences:
    """Learns from statistics ``x`` and labels ``y`` (1: preferred to 0) by Newton's steps on the logistic loss of pairs."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.clip((x - middle) / spread, -10, 10)
    out = Preferences(middle, spread, np.quantile(z, HINGES, axis=0), np.zeros(x.shape[1] * (1 + len(HINGES))), 0.0)
    terms = out.terms(x)
    better, worse = pairs(np.flatnonzero(y == 1), np.flatnonzero(y == 0), rounds)
    difference = terms[better] - terms[worse]
    ridge = RIDGE * len(difference)
    loss = lambda w: np.logaddexp(0, -(difference @ w)).sum() + ridge / 2 * w @ w
    w = out.weights
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(difference @ w))
        gradient = ridge * w - difference.T @ p
        step = np.linalg.solve((difference * (p * (1 - p))[:, None]).T @ difference + ridge * np.eye(len(w)), gradient)
        rate, before = 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > before:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    out.weights = w
    out.threshold = quantile(terms @ w, y)
    return out


def quantile(scores: np.ndarray, y: np.ndarray) -> float:
    """The score between those of the rows on either side of a quantile: of the quantiles within ``NEAR`` of the share of bad labels the
    one with the fewest wrong rows, and of equals the lowest.
    """
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], y[order] == 1
    bad = int((~good).sum())
    # so many rows lie below the threshold
    below = np.arange(max(1, int(bad * (1 - NEAR))), min(len(y) - 1, int(bad * (1 + NEAR)) + 1) + 1)
    below = below[scores[below] > scores[below - 1]] if (scores[below] > scores[below - 1]).any() else below
    wrong = np.cumsum(good)[below - 1] + bad - np.cumsum(~good)[below - 1]
    k = below[int(np.argmin(wrong))]
    return float((scores[k - 1] + scores[k]) / 2)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def learn(counted: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Preferences | None:
    """Fits on at most ``sample_rows`` labelled rows that aren't held out. Their counts, some numbers each, come to the driver; texts do not."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull() & ~held_out())
    rows = told.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    one = counted.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct(*COUNTS), "text_hash").alias("first"))
    known = one.select("quality", "first.*").toPandas()
    y = (known["quality"] > 0).to_numpy().astype(int)
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort([*known[COUNTS].to_numpy().T, y])
    return fit(features(known[COUNTS].to_numpy()[order]), y[order])


def scored(counted: DataFrame, model: Preferences | None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``CUT`` on) of rows of COUNTS."""
    schema = arrow_schema(RATED)

    def judge(batches):
        for batch in batches:
            counts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS])
            score = model.score(features(counts)) if model else np.full(len(counts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], schema=schema)

    return counted.select("doc_id", held_out().alias("held_out"), *COUNTS).mapInArrow(judge, RATED)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    counted = written(statistics(whole_texts(docs)), "statistics")
    return scored(counted, learn(counted, labels))


def op13_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
