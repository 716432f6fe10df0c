"""From raw documents to packed training sequences.

Each stage takes all documents that the one before it kept. The quality rules drop what
they reject; of each near-duplicate group one document stays; secrets are replaced by a
mark; what is left is packed. All stages but the last return the columns of ``documents``.

Defined results, besides those of each stage's operator: null and empty texts fail the quality rules; repeated rows that pass are one
group of near duplicates, of which one stays; an empty table gives an empty one; other columns, whatever their names, are kept by all stages but the
last. Texts of any length are taken whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import near_dedup, packing, quality, secrets
from meterline.llm.shared import table, written


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``kept`` (doc_id, text_hash)."""
    keys = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).hint("shuffle_hash")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["kept_id"]) & (text == keys["kept_hash"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the base rules and the model of document statistics accept."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id, of those the one with the smallest text hash, and one of
    equal rows. A null doc_id comes after all others. Rows without words are components of their own and all stay.
    """
    rows = written(near_dedup.grouped(docs), "grouped")
    counts = rows.where("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = counts.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash", "n")).alias("first")).select("first.*")
    single = first.where("n = 1").select("doc_id", "text_hash").unionByName(rows.where("component is null").select("doc_id", "text_hash").distinct())
    return _only(docs, single).unionByName(_only(docs, first.where("n > 1")).dropDuplicates(["doc_id", "text"]))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with ``[SECRET]`` for each secret of their texts and ``n_chars`` as it then is; a null text stays null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences, as ``op1_packing`` gives them."""
    return packing.packed_digest(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_duplicates), ("secrets", without_secrets), ("packing", packed)]

#: The quality model, the near-duplicate components and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
