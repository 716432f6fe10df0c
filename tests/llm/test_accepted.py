"""The quality stage in one pass keeps what the rated table keeps, with all columns."""

import collections

from pyspark.sql import functions as F

from meterline.llm import quality


def test_one_pass_keeps_the_same_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", F.lit("a").alias("row"), F.lit(False).alias("kept"), F.lit(1.5).alias("told"), F.array(F.lit(1)).alias("text_hash"), F.current_timestamp().alias("n_words"))
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(5)).unionByName(docs.limit(4).withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(odd)
    kept = quality.accepted(docs, labels)
    assert kept.schema.names == docs.schema.names and kept.dtypes == docs.dtypes
    want = collections.Counter((r.doc_id, r.text_hash) for r in quality.rate(docs, labels).where("kept").collect())
    got = collections.Counter((r.doc_id, r.h) for r in kept.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect())
    assert got == want and sum(got.values()) < docs.count()
    assert quality.accepted(docs.limit(0), labels).count() == 0
    alone = {r.doc_id for r in quality.accepted(docs, labels.limit(0)).select("doc_id").collect()}
    assert set(r for r, _ in got) <= alone
