"""Long texts against the tiktoken library, without a limit of length."""

import collections

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from meterline.llm import byte_bpe
from tests.llm.test_operators import odd_rows, pairs


def test_long_texts(spark, sf):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) >= 5000").orderBy(F.desc(F.length("text")), "doc_id").limit(3)
    df = odd_rows(spark).where("length(text) >= 5000").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = pairs(df)
    assert len(rows) >= 3
    got = collections.Counter((r.doc_id, tuple(memoryview(r.ids).cast("I")), bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(df, path, P.PATTERN), path).collect())
    assert got == collections.Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in rows)


@pytest.mark.parametrize("group", [1, 3])
def test_groups_of_blocks_ask_as_one(spark, sf, monkeypatch, group):
    monkeypatch.setattr(byte_bpe, "GROUP", group)
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 10_000)
    monkeypatch.setattr(byte_bpe, "WORD_BUCKETS", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: list(memoryview(r.ids).cast("I")) if r.ids else [] for r in byte_bpe.encode(docs, path, P.PATTERN).collect()}
    assert got == {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    assert byte_bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0
