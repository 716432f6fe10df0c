"""The number of chaining groups follows the spans."""

from meterline.llm import chat_format


def test_groups_follow_the_spans(spark, monkeypatch):
    dealt = spark.range(500).selectExpr("id as conv_id", "0L as span")
    assert chat_format._chains(dealt) == 64
    monkeypatch.setattr(chat_format, "CHAIN_SPANS", 2)
    assert chat_format._chains(dealt) == 250
