"""Periodic runs of words, found by convolving blocks with the words that follow them.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 2 * q)`` long, that no neighbour extends. At each
dyadic scale L, blocks of L words begin at every L/2 words. A run whose period lies in the scale's range (``distances``)
holds a whole block together with the block's next occurrence q words on, so the sums of squared differences between each
block and the window after it, as numbers of words, are zero there. They are worked out by number-theoretic transforms modulo
as many primes as the largest possible sum needs, so that a zero is exact. A block is only transformed if each of its words comes again
within the window's reach; no other block can recur there, and only if a run already found doesn't tell all its occurrences. Distances of neighbouring blocks are chained, and a
chain's ends are compared word by word, at most half a block on either side. Time grows with n log(n)^2 in the words of a text.

Defined results: a null or empty text, or one of white space, has no words and no runs; repeated rows get the same runs each; an empty
table gives an empty one; columns other than ``doc_id`` and ``text`` are ignored. Texts of any length are taken whole: all
blocks of a scale together are transformed in steps of ``STEP`` numbers, and one block at once where it is longer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, documents, release, slices, whole_texts

#: Words of the shortest run, and of the blocks of the first scale.
LEAST, FIRST = 12, 4
#: Text of a batch, and numbers that are transformed at once.
BATCH_BYTES, STEP = 4 << 20, 1 << 20
#: Primes below 2**31 with their primitive roots; each has roots of unity of order 2**25 at least. Fixed values.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def distances(block: int) -> tuple[int, int]:
    """The least and the largest period that blocks of ``block`` words look for. The ranges of all scales cover all periods from 1."""
    return 1 if block == FIRST else block * 3 // 2 - 1, 3 * block - 2


def _times(a: np.ndarray, b: np.ndarray | int, p: int) -> np.ndarray:
    out = a * b
    out -= (out // p) * p
    return out


def _powers(root: int, count: int, p: int) -> np.ndarray:
    out = np.ones(count, np.int64)
    done = 1
    while done < count:
        step = pow(root, done, p)
        n = min(done, count - done)
        out[done : done + n] = _times(out[:n], step, p)
        done += n
    return out


def transform(rows: np.ndarray, p: int, generator: int, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row modulo ``p``; rows are powers of two long. Without the division by the length in the inverse."""
    m, n = rows.shape
    root = pow(generator, (p - 1) // n, p)
    powers = _powers(pow(root, p - 2, p) if inverse else root, max(1, n // 2), p)
    x, half = rows.reshape(m, n, 1), n // 2
    while half:
        # halves of what is left against each other, results side by side
        a, b = x[:, :half], x[:, half:]
        total, rest = a + b, a - b
        total -= p * (total >= p)
        rest += p * (rest < 0)
        rest = _times(rest, powers[:: n // 2 // half][:half, None] if half > 1 else powers[:1, None], p)
        x = np.stack((total, rest), axis=2).reshape(m, half, -1)
        half //= 2
    return x.reshape(m, n)


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray, largest: int) -> np.ndarray:
    """Where each block occurs in its window: true at t if the sum of squared differences from ``windows[t:]`` is zero. Numbers are 0 to ``largest``."""
    m, size = blocks.shape
    places = windows.shape[1] - size + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    zero, bound = np.ones((m, places), bool), size * largest * largest
    covered = 1
    for p, generator in PRIMES:
        b, w = (blocks % p, windows % p) if largest >= p else (blocks, windows)
        turned, padded = np.zeros((m, n), np.int64), np.zeros((m, n), np.int64)
        turned[:, 0], turned[:, n - size + 1 :] = b[:, 0], b[:, :0:-1]
        padded[:, : w.shape[1]] = w
        both = _times(transform(turned, p, generator), transform(padded, p, generator), p)
        product = _times(transform(both, p, generator, inverse=True)[:, :places], pow(n, p - 2, p), p)
        squares = np.zeros((m, windows.shape[1] + 1), np.int64)
        np.cumsum(_times(w, w, p), axis=1, out=squares[:, 1:])
        own = _times(b, b, p).sum(axis=1, keepdims=True)
        zero &= (own + squares[:, size:] - squares[:, :places] - 2 * product) % p == 0
        covered *= p
        if covered > bound:
            return zero
    raise ValueError(f"blocks of {size} words with numbers up to {largest} need more primes")


class Runs(NamedTuple):
    """Runs of several texts: which text, the first word in it, words, and the period; by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _recurring(gaps: np.ndarray, longest: int):
    """For each scale, its block length and the starts of the blocks all of whose words recur within its reach."""
    size = FIRST
    reach = np.maximum(gaps[:-1], gaps[1:])
    most = np.maximum(reach[:-2:2], reach[2::2]) if len(reach) > 2 else reach[:0]  # of words [2i, 2i + 4)
    while distances(size)[0] * 2 <= longest and len(most):
        yield size, np.flatnonzero(most <= distances(size)[1]) * (size // 2)
        most = np.maximum(most[:-2:2], most[2::2])
        size *= 2


def runs_of(words: np.ndarray, begins: np.ndarray) -> Runs:
    """All runs of texts given as numbers of their words, one text after another; text i has the words from ``begins[i]`` to ``begins[i + 1]``."""
    n = len(words)
    lengths = np.diff(begins)
    none = Runs(*(np.empty(0, np.int64) for _ in range(4)))
    if not n or lengths.max() < LEAST:
        return none
    of = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(words, kind="stable")
    far = np.iinfo(np.int64).max
    gaps = np.full(n, far)
    here, later = order[:-1], order[1:]
    again = (words[here] == words[later]) & (of[here] == of[later])
    gaps[here[again]] = (later - here)[again]
    # a text's last word has no next one, so that no block crosses into another text
    scales = [(size, starts) for size, starts in _recurring(gaps, int(lengths.max())) if len(starts)]
    if not scales:
        return none
    # numbers within each text that is looked at, so that squares stay small
    looked = np.zeros(len(lengths), bool)
    for _, starts in scales:
        looked[of[starts]] = True
    where = np.flatnonzero(looked[of])
    pair = of[where] * (int(words.max()) + 1) + words[where]
    distinct, place = np.unique(pair, return_inverse=True)
    first = np.searchsorted(distinct, np.flatnonzero(looked) * (int(words.max()) + 1))
    kinds = np.zeros(len(lengths), np.int64)
    kinds[looked] = np.diff(np.append(first, len(distinct)))
    base = np.zeros(len(lengths), np.int64)
    base[looked] = first
    own = np.zeros(n, np.int64)
    own[where] = place - base[of[where]]
    # left end, right end and period of the runs of smaller scales
    known = np.empty((0, 3), np.int64)
    for size, starts in scales:
        stretches = _stretches(own, kinds, of, begins, size, starts, _covered(known, starts, size))
        rows = np.concatenate([known, stretches])
        rows = rows[np.lexsort(rows.T[::-1])]
        # a multiple of the period repeats the same stretch
        known = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    text = of[known[:, 0]]
    out = Runs(text, known[:, 0] - begins[text], known[:, 1] - known[:, 0], known[:, 2])
    order = np.lexsort((out.period, out.start, out.text))
    return Runs(*(c[order] for c in out))


def _covered(known: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each block, where the run ends that it lies in and whose period is at most half of it; 0 where there is none. Two such runs of one block would be the same run.

    Up to that end the block occurs at multiples of the run's period alone, which give no other run.
    """
    ends = np.zeros(len(starts), np.int64)
    left, right, period = known[known[:, 2] <= size // 2].T
    first, last = np.searchsorted(starts, left), np.searchsorted(starts, right - size, side="right")
    count = np.maximum(last - first, 0)
    ends[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())] = np.repeat(right, count)
    return ends


def _stretches(own: np.ndarray, kinds: np.ndarray, of: np.ndarray, begins: np.ndarray, size: int, starts: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Left end, right end and distance of stretches long enough for runs that hold a block of this scale and an occurrence of it."""
    low, high = distances(size)
    needed = starts + high + size > covered
    starts, covered = starts[needed], covered[needed]
    reach, step = high - low + size, max(1, STEP // (4 * size))
    found = []
    for at in range(0, len(starts), step):
        s = starts[at : at + step]
        inside = s[:, None] + low + np.arange(reach)
        windows = np.where(inside < begins[of[s] + 1][:, None], own[np.minimum(inside, len(own) - 1)], kinds[of[s]][:, None])
        i, t = np.nonzero(zero_mismatches(own[s[:, None] + np.arange(size)], windows, int(kinds[of[s]].max())))
        news = s[i] + t + low + size > covered[at : at + step][i]
        found.append(np.column_stack([s[i], t + low])[news])
    seeds = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if not len(seeds):
        return np.empty((0, 3), np.int64)
    start, distance = (np.ascontiguousarray(c) for c in seeds[np.lexsort(seeds.T)].T)
    opens = np.append(True, (distance[1:] != distance[:-1]) | (start[1:] - start[:-1] != size // 2))
    head = np.flatnonzero(opens)
    left, right, distance = start[head], start[np.append(head[1:], len(start)) - 1] + size, distance[head]
    for at in range(0, len(left), max(1, STEP // size)):
        some = slice(at, at + max(1, STEP // size))
        left[some], right[some] = _extended(own, left[some], right[some], distance[some], size // 2, begins[of[left[some]]], begins[of[left[some]] + 1])
    rows = np.column_stack([left, right + distance, distance])
    return rows[rows[:, 1] - left >= np.maximum(LEAST, 2 * distance)]


def _extended(words: np.ndarray, left: np.ndarray, right: np.ndarray, distance: np.ndarray, most: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of stretches whose words equal those ``distance`` further on, moved on by up to ``most`` words while that holds inside the text."""
    step = np.arange(most)
    ahead = right[:, None] + step
    same = ahead + distance[:, None] < high[:, None]
    same &= words[np.minimum(ahead, len(words) - 1)] == words[np.minimum(ahead + distance[:, None], len(words) - 1)]
    behind = left[:, None] - 1 - step
    alike = behind >= low[:, None]
    alike &= words[np.maximum(behind, 0)] == words[np.minimum(np.maximum(behind, 0) + distance[:, None], len(words) - 1)]
    return left - np.cumprod(alike, axis=1).sum(axis=1), right + np.cumprod(same, axis=1).sum(axis=1)


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Which of a text's ``n`` words are in no run after that run's first period."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, runs.start + runs.period, 1)
    np.add.at(inside, runs.start + runs.length, -1)
    return np.cumsum(inside[:n]) == 0


#: Gives, for a doc_id and a number of words, which word stands at each place; None: the text as it is.
Planted = Callable[[int | None, int], np.ndarray | None]


def unchanged(doc_id: int | None, n: int) -> None:
    return None


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """A tenth of the texts, by a hash of their ids, with their words from some place on replaced by repetitions of the first few there; a row without an id stays."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _texts(batch: pa.RecordBatch, planted: Planted):
    """Each text of the batch as its words, the places its words come from, and its runs."""
    joined = [b" ".join(x.as_buffer().to_pybytes().split()) if x.is_valid else b"" for x in batch.column("text")]
    found = pc.split_pattern(pa.array(joined, pa.binary()).cast(pa.string()), " ")
    numbers = found.flatten().dictionary_encode().indices.to_numpy()
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())]).astype(np.int64)
    filled = np.array([bool(x) for x in joined], bool)
    counts = np.where(filled, np.diff(begins), 0)
    places: list[np.ndarray | None] = []
    source = np.arange(len(numbers))
    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        moved = planted(doc_id, int(counts[i]))
        places.append(moved)
        if moved is not None:
            source[begins[i] : begins[i + 1]] = begins[i] + moved
    # a text without words is one empty unit, too short for a run
    runs = runs_of(numbers[source].astype(np.int64), begins)
    edges = np.searchsorted(runs.text, np.arange(len(joined) + 1))
    for i, text in enumerate(joined):
        yield text, int(counts[i]), places[i], Runs(*(c[edges[i] : edges[i + 1]] for c in runs))


def _words(text: bytes, n: int, places: np.ndarray | None, runs: Runs) -> bytes:
    """The words that stay, joined by one space."""
    if not len(runs.start) and places is None:
        return text
    words = text.split(b" ")
    if places is not None:
        words = [words[k] for k in places.tolist()]
    return b" ".join([w for w, stays in zip(words, kept_words(n, runs).tolist()) if stays])


def periodic_runs(docs: DataFrame, planted: Planted = unchanged) -> DataFrame:
    """doc_id, ``runs`` by start and period, and ``collapsed``: the words that are in no run after its first period, joined by one space."""
    schema = arrow_schema(FOUND)

    def find(batches):
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                runs, texts = [], []
                for text, n, places, found in _texts(some, planted):
                    runs.append([dict(zip(("start", "length", "period"), row)) for row in np.column_stack(found[1:]).tolist()])
                    texts.append(_words(text, n, places, found).decode())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(runs, schema.field("runs").type), pa.array(texts, pa.string())], schema=schema)
            release()

    return whole_texts(docs).mapInArrow(find, FOUND)


def run_digests(docs: DataFrame, planted: Planted = unchanged) -> DataFrame:
    """Per document the number of its runs, the longest of them (of equals the first, then that of the least period), and
    digests of all runs and of the collapsed text; made in the same pass as the runs, whose text needn't leave the task.
    """
    schema = arrow_schema(DIGEST)

    def find(batches):
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                rows = []
                for text, n, places, found in _texts(some, planted):
                    longest: tuple = (None,) * 4
                    if len(found.start):
                        k = int(np.argmax(found.length))  # the first of equals
                        start, length, period = (int(c[k]) for c in found[1:])
                        longest = start, length, period, 1000 * length // period
                    lines = "".join([f"{a},{b},{c}\n" for a, b, c in np.column_stack(found[1:]).tolist()])
                    rows.append((len(found.start), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_words(text, n, places, found)).hexdigest()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)
            release()

    return whole_texts(docs).mapInArrow(find, DIGEST)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir), repeated_tail)
