"""The near-dedup stage leaves one row of each group whatever the ids are."""

import corpus_pipeline


def test_repeated_and_null_ids(spark, sf):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near = a + " more"
    rows = [(1, a, "x"), (1, a, "y"), (1, near, "x"), (2, b, "x"), (2, c, "x"), (None, d, "x"), (None, d, "x"), (3, "", "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    kept = sorted(((r.doc_id or 0, r.text or "") for r in got), key=str)
    assert [t for _, t in kept if t[:2] == "a0"] in ([a], [near])
    assert sorted((i, t) for i, t in kept if t[:2] != "a0") == [(0, d), (2, b), (2, c), (3, ""), (4, "")]
