"""The preference model by its held-out accuracy, and its pairs and threshold by plain counting."""

import zlib

import numpy as np

from meterline.llm import preference
from meterline.llm.shared import table


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in preference.op13_preference(spark, big).collect()}
    docs = table(spark, big, "documents").select("doc_id").collect()
    assert sorted(rows) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    told = [(r.quality, rows[r.doc_id]) for r in table(spark, big, "labels").collect() if rows[r.doc_id].held_out]
    good, bad = ([r.score for q, r in told if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == q for q, r in told]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(preference.held_out())
    mixed = labels.where(~preference.held_out()).unionByName(turned)
    scores = [{(r.doc_id, r.score) for r in preference.rate(docs, x).collect()} for x in (labels, mixed.orderBy("quality"))]
    assert scores[0] == scores[1]


def test_pairs_meet_every_row():
    good, bad = np.arange(30), np.arange(30, 37)
    better, worse = preference.pairs(good, bad, rounds=3)
    assert len(better) == 90 and set(better) == set(good) and set(worse) == set(bad)
    assert (np.bincount(better) == 3).all() and np.bincount(worse)[30:].min() >= 12


def test_quantile_has_fewest_wrong_rows():
    rng = np.random.default_rng(3)
    y = (rng.random(500) > 0.3).astype(int)
    scores = y + rng.normal(0, 0.4, 500)
    at = preference.quantile(scores, y)
    wrong = lambda t: ((scores >= t) != (y == 1)).sum()
    n, bad = np.sort(scores), (y == 0).sum()
    near = [(n[k - 1] + n[k]) / 2 for k in range(int(bad * 0.9), int(bad * 1.1) + 2)]
    assert wrong(at) == min(map(wrong, near))


def test_loss_is_at_its_least(sf):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 13)), rng.integers(0, 2, 200)
    x[y == 1, 2] += 1
    model = preference.fit(x, y)
    terms = model.terms(x)
    better, worse = preference.pairs(np.flatnonzero(y == 1), np.flatnonzero(y == 0))
    d = terms[better] - terms[worse]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + preference.RIDGE * len(d) / 2 * (w @ w)
    for _ in range(20):
        assert loss(model.weights) <= loss(model.weights + rng.normal(0, 0.01, len(model.weights)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "", 0), (1, None, 1), (None, "a b c", 2), (7, "word " * 50_000, 3), (7, "word " * 50_000, 3)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (9, 1)], "doc_id long, quality int")
    rows = preference.rate(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and [r.held_out for r in rows if r.doc_id is None] == [True]
    kinds = spark.createDataFrame([(i, "good plain words of some length" if i % 2 else "BAD!! ### ###") for i in range(60)] + [(None, None), (3, "")], "doc_id long, text string")
    rated = preference.rate(kinds, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")).collect()
    assert len(rated) == 62 and all(r.predicted == r.doc_id % 2 for r in rated if r.doc_id is not None and r.doc_id != 3)
    assert preference.rate(docs.limit(0), labels).collect() == []
