"""run() on repeated rows, null ids and texts, very long texts, columns with clashing names, and nothing at all."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import quality
from tests.llm.test_operators import odd_rows, pairs, tokenizer
from tests.llm.test_pipeline import without_secrets


def stored(df, folder, labels):
    df.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, sf, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.rate(docs, labels).where("kept").select("doc_id")
    good = docs.join(kept, "doc_id", "left_semi").orderBy("doc_id").limit(12).select("doc_id", "text")
    long = spark.createDataFrame([(900, " ".join(f"word{k} of{k % 977} a{k % 31}." for k in range(60_000)))], "doc_id long, text string")
    rows = good.unionByName(good.where("doc_id % 2 = 0")).unionByName(good.orderBy("doc_id").limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(long)
    for name in ("lang", "source", "component", "rules", "kept", "text_hash"):
        rows = rows.withColumn(name, F.lit("x"))
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "start": F.lit(1)})
    rows = rows.unionByName(odd_rows(spark).withColumns({"kept": F.lit("x"), "text_hash": F.lit("x")}).drop("block").withColumn("start", F.lit(1)))
    folder = stored(rows, tmp_path, labels)
    got = corpus_pipeline.run(spark, folder).collect()
    rated = quality.rate(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("kept").select("doc_id", "text_hash").distinct().collect()
    passed = {(r.doc_id, r.text_hash) for r in rated}
    hashes = {r.text: r.h for r in rows.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    # of each group of near copies the row of the smallest id and, under one id, of the smallest hash stays
    left = sorted({(doc_id is None, doc_id or 0, hashes[text], text) for doc_id, text in pairs(rows) if (doc_id, hashes[text]) in passed})
    texts = sorted({text for *_, text in left})
    sets = {t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for t in texts}
    group = {t: t for t in texts}
    for a in texts:
        for b in texts:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[b], group[a]
                group = {t: new if g == old else g for t, g in group.items()}
    first = {}
    for unnamed, doc_id, _, text in left:
        first.setdefault(group[text], (None if unnamed else doc_id, text))
    encode = tokenizer("word_bpe_49k.json")
    want = collections.Counter()
    for doc_id, text in first.values():
        n = len(encode(without_secrets(text))) + 1
        want.update((doc_id, k // 2048, k, min(2048, n - k)) for k in range(0, n, 2048))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want and len(first) >= 8


def test_no_rows(spark, sf, tmp_path):
    folder = stored(spark.read.parquet(f"{sf}/documents.parquet").limit(0), tmp_path, spark.read.parquet(f"{sf}/labels.parquet").limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
