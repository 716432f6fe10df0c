"""Rows without ids, and extra columns that clash with the operators' own."""

import collections

from meterline.llm import chat_format, exact_topk
from tests.oracle import connection, same

VECTORS = "vec_id long, embedding array<float>, score long, rank int, uid long, dims int, block string"


def test_exact_topk(spark, tmp_path):
    rows = [(i if i % 7 else None, [float((i * k) % 11) - 5 for k in range(1, 12)], i, i, i, i, "x") for i in range(100, 200)]
    rows += [(50, None, 0, 0, 0, 0, "x"), (50, [1.0, None] + [0.0] * 9, 0, 0, 0, 0, "x"), (150, [1.0] * 11, 0, 0, 0, 0, "x"), (150, [2.0] * 3, 0, 0, 0, 0, "x"), (100, [], 0, 0, 0, 0, "x")]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(path)
    con = connection("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = exact_topk.top_k(spark.read.parquet(path), "vec_id % 50 = 0")
    same(con, exact_topk.ORACLE, got)
    assert got.where("query_id = 150").count() == 10


def test_turns_without_a_number(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    model = chat_format.Model(chat_format.count_model(chat_format.transcripts(table)))
    odd = spark.createDataFrame([(1, None, "user", "Where?"), (1, None, "user", "Where?"), (None, None, None, None), (7, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    rows = table.where("conv_id < 5").select("conv_id", "turn", "role", "text").unionByName(odd)
    raw = chat_format.transcripts(rows)
    parsed = chat_format.parse(raw.drop("state"), model).collect()
    want = collections.Counter((r.conv_id, r.text) for r in raw.collect())
    assert collections.Counter((r.conv_id, r.text) for r in parsed) == want
    last = [r.line for r in parsed if r.conv_id == 1]
    assert max(last) == chat_format.LAST and sum(x == chat_format.LAST for x in last) >= 2
