"""Clusters of many components, whose nodes share bands but are seldom linked."""

import collections

import pytest
from pyspark.sql import functions as F

from meterline.llm import near_dedup
from tests.llm.test_operators import pairs, plain_components

CASES = {
    # a chain of small bands through all nodes, and one band that holds them all
    "chain": [(b, n) for b in range(1, 300) for n in range(b, min(b + 6, 300))],
    "hub": [(1, n) for n in range(200)] + [(2, n) for n in range(5)],
}


@pytest.mark.parametrize("case", CASES)
def test_both_sides_of_a_cell_are_bounded(spark, monkeypatch, case):
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)
    members = spark.createDataFrame(CASES[case], "band long, node long")
    labels = members.select("node", F.col("node").alias("component")).distinct()
    asks, rows = near_dedup.sides(near_dedup.dealt(members, labels))
    cells = [collections.defaultdict(set), collections.defaultdict(set)]
    for side, found in zip((asks, rows), cells):
        for r in side.collect():
            found[r.cluster, r.band, r.ask, r.row].add(r.node)
        assert max(map(len, found.values())) <= 2 * near_dedup.MEMBERS
    met = {frozenset((a, b)) for cell, left in cells[0].items() for a in left for b in cells[1][cell]}
    in_band = collections.defaultdict(set)
    for band, node in CASES[case]:
        in_band[band].add(node)
    assert {frozenset((a, b)) for nodes in in_band.values() for a in nodes for b in nodes if a != b} <= met
    if case == "chain":
        assert sum(map(len, cells[0].values())) + sum(map(len, cells[1].values())) < 300 * 300 / 16


def test_templated_texts_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)
    # a tenth of the words differs between neighbours, so most pairs are below the limit
    texts = [(k, " ".join([f"t{j}" for j in range(100)] + [f"u{k // 2}_{j}" for j in range(14)] + [f"v{k}_{j}" for j in range(3 + k % 9)])) for k in range(160)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 2).collect())
    assert got == plain_components(pairs(df), 2)


def test_hot_keys_are_spread_and_no_row_is_lost(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 50)
    many = spark.range(3000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    one = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = near_dedup.spread(many, one, "k", "v")
    assert sorted((r.k, r.v, r.w) for r in got.collect()) == sorted((7 if i < 2000 else i, i, 2 * (7 if i < 2000 else i)) for i in range(3000))
    assert near_dedup.spread(many.limit(0), one, "k", "v").count() == 0
