"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from meterline.llm import periodic
from meterline.llm.shared import table


def plain_runs(words):
    """(start, length, period) of every run, by trying each period at each place."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q) and not any(words[i : j + q - d] == words[i + d : j + q] for d in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_row(doc_id, text, planted):
    words = (text or "").encode().split()
    n = len(words)
    if planted and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *facts, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def made_up(rng):
    kinds = rng.choice([1, 2, 2, 3, 5, 20])
    words = []
    while len(words) < rng.choice([0, 1, 11, 12, 13, 60, 200, 400]):
        unit = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 10, 11, 22, 23, 24, 46, 47]))]
        words += (unit * 10)[: rng.randrange(1, 4 * len(unit) + 2)]
    return words


@pytest.mark.parametrize("step", [periodic.STEP, 64])
def test_random_texts(step, monkeypatch):
    monkeypatch.setattr(periodic, "STEP", step)
    rng = random.Random(5)
    for _ in range(40):
        texts = [made_up(rng) for _ in range(rng.choice([1, 4]))]
        found = periodic.runs_of(np.array(sum(texts, []), np.int64) * rng.choice([1, 1 << 20]), np.cumsum([0, *map(len, texts)]))
        got = [[] for _ in texts]
        for text, *run in zip(*(c.tolist() for c in found)):
            got[text].append(tuple(run))
        assert got == [plain_runs(t) for t in texts]


def test_transform_is_exact():
    rng = np.random.default_rng(0)
    # sums beyond the first prime need the second, and beyond both the third
    for largest, size in ((3, 4), (1 << 14, 8), (1 << 30, 16)):
        blocks, windows = rng.integers(0, largest, (20, size)), rng.integers(0, largest, (20, 3 * size))
        windows[::2, 5 : 5 + size] = blocks[::2]
        want = np.array([[(w[t : t + size] == b).all() for t in range(2 * size + 1)] for b, w in zip(blocks, windows)])
        assert (periodic.zero_mismatches(blocks, windows, largest) == want).all()
        assert want[::2, 5].all()


def test_sums_that_a_prime_divides_are_no_matches():
    p = periodic.PRIMES[0][0]
    # 44864**2 + 767**2 + ... : four squares that add up to the first prime
    four = next((a, b, c, d) for a in range(44869, 44000, -1) for b in range(1000) for c in range(30) for d in [int((p - a * a - b * b - c * c) ** 0.5) if p - a * a - b * b - c * c >= 0 else -1] if d >= 0 and a * a + b * b + c * c + d * d == p)
    assert not periodic.zero_mismatches(np.zeros((1, 4), np.int64), np.array([[*four, 1, 1]]), 44869)[0, 0]


def test_long_texts():
    n = 60_000
    assert periodic.runs_of(np.zeros(n, np.int64), np.array([0, n])).length.tolist() == [n]
    tiled = np.tile(np.arange(20_000), 3)
    assert [c.tolist() for c in periodic.runs_of(tiled, np.array([0, n]))] == [[0], [0], [n], [20_000]]


def key(row):
    return str(tuple(row))


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = periodic.op11_periodic_runs(spark, sf).collect()
    assert sorted(map(key, got)) == sorted(key(digest_row(r.doc_id, r.text, True)) for r in docs)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a " * 40, "a b c d " * 9, "x " + "y\n" * 11, "y " * 12, "  é\x0bé " * 20, "one two three", "long " * 30_000]
    docs = [(None if i % 4 == 0 else i // 2, t, i) for i, t in enumerate(texts * 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, runs int")
    short = frame.where("text is null or length(text) < 9999")
    assert sorted(map(key, periodic.run_digests(short).collect())) == sorted(key(digest_row(i, t, False)) for i, t, _ in docs if len(t or "") < 9999)
    found = {r.collapsed: r.runs for r in periodic.periodic_runs(frame).collect()}
    assert [(r.start, r.length, r.period) for r in found["a b c d"]] == [(0, 36, 4)]
    assert [(r.start, r.length, r.period) for r in found["long"]] == [(0, 30_000, 1)]
    assert found["x " + " ".join("y" * 11)] == [] and periodic.periodic_runs(frame.limit(0)).count() == 0
