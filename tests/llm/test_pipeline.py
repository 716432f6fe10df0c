"""run() against the same stages done plainly."""

import collections
import re

import public_tokenizers as P

import corpus_pipeline
from meterline.llm import quality
from tests.llm.test_operators import pairs, plain_components, plain_spans, plain_statistics, tokenizer


def without_secrets(text):
    out, at = [], 0
    for start, _, _, end in plain_spans(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rated = {r.doc_id: r.kept for r in quality.rate(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [(i, t) for i, t in pairs(docs) if rated[i]]
    assert all(not plain_statistics(t)[-1] for _, t in rows)
    first = {doc_id for doc_id, _, component in plain_components(rows, 5) if doc_id == component}
    encode = tokenizer("word_bpe_49k.json")

    want = collections.Counter()
    for doc_id, text in rows:
        if doc_id in first:
            n = len(encode(without_secrets(text))) + 1
            want.update((doc_id, k // 2048, k, min(2048, n - k)) for k in range(0, n, 2048))
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
