"""Grams of a block are summed as they come: the same counts however few are held."""

import numpy as np

from meterline.llm import lm_score


def test_summed():
    keys, sums = lm_score.summed([np.array([3, 5]), np.array([1, 5, 9])], [np.array([2, 0]), np.array([1, 4, 0])])
    assert keys.tolist() == [1, 3, 5, 9] and sums.tolist() == [1, 2, 4, 0]
    assert [len(x) for x in lm_score.summed([], [])] == [0, 0]


def test_same_counts_part_by_part():
    parts = [np.unique(np.random.default_rng(k).integers(0, 50, 40), return_counts=True) for k in range(9)]
    want = lm_score.summed([k for k, _ in parts], [n for _, n in parts])
    held = ([], [])
    for k, n in parts:
        held = lm_score.summed([held[0], k], [held[1], n]) if len(held[0]) else (k, n)
    assert all((a == b).all() for a, b in zip(want, held))
    assert lm_score.HELD_GRAMS <= 1_000_000
