"""Encoding whole texts with a public tokenizer file inside tasks.

A word-level tokenizer's text falls apart at white space into units that it treats independently. Each distinct unit is
encoded once, by the tokenizers library, and kept for the life of the Python worker in a bounded cache; units of rarer
scripts are handed to the library as they are.

A byte-level vocabulary in which every token is what the library's merges make of its own bytes gives the same ids when
merges are looked up by the joined bytes, as the tiktoken library does in a third of the time. Texts of Latin letters and plain white space
go that way after this has been checked for all tokens; all others, and those that hold a special token's name, are handed to the tokenizers library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct units and words that a worker keeps before it starts afresh; never changes a result.
CACHE_UNITS = 700_000
#: Text of a batch.
BATCH_BYTES = 4 << 20

#: White space but for the space, and controls that some libraries count as such.
_WHITE = r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Where a space is next to other white space, which a pre-tokenizer may join.
_SPACE_MEETS_WHITE = f"  | [{_WHITE}]|[{_WHITE}] "
#: Texts of these characters are cut alike by all libraries, whatever version of Unicode they know.
_LATIN = r"^[\t\n\r\x20-\x7e\x{a1}-\x{24f}]*$"
#: Above this, or among these, the library's own normalising and splitting are used.
_PLAIN_BELOW = "\u0250"
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Marks after a word that are words of their own.
STOPS = (".", ",", ";", ":", "!", "?")
#: How byte-level vocabularies of this family cut texts into words.
_BYTE_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Cut(NamedTuple):
    """Texts as numbers of units: of ``rest`` (after a space), then ``first`` (a text's begin), then ``whole`` (texts that are not cut)."""

    numbers: np.ndarray
    #: Where each text's numbers begin, and the end; every text has one at least.
    begins: np.ndarray
    rest: pa.Array
    first: pa.Array
    whole: list[str]


def cut_at_spaces(texts: pa.Array, uncut: pa.Array) -> Cut:
    """``uncut`` marks the texts that stay whole."""
    whole = texts.filter(uncut).to_pylist()
    if whole:
        texts = pc.if_else(uncut, "", texts)
    found = pc.split_pattern(texts, " ")
    coded = found.flatten().dictionary_encode()
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(found).to_numpy(), out=begins[1:])
    numbers, rest = coded.indices.to_numpy().copy(), coded.dictionary
    if not len(texts):
        return Cut(numbers, begins, rest, rest, [])
    # a text's first unit has no space before it
    seen, which = np.unique(numbers[begins[:-1]], return_inverse=True)
    first = rest.take(pa.array(seen))
    numbers[begins[:-1]] = len(rest) + which
    if whole:
        numbers[begins[:-1][uncut.to_numpy(zero_copy_only=False)]] = len(rest) + len(first) + np.arange(len(whole))
    return Cut(numbers, begins, rest, first, whole)


def space_meets_white(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, _SPACE_MEETS_WHITE)


def gathered(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that ``numbers`` name, one after another, and each run's size."""
    n = sizes[numbers]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts[numbers] - (ends - n), n) + np.arange(total)], n


def byte_alphabet() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Units(dict):
    """Unit to ids; a missing one is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE_UNITS:
            self.clear()
        ids = self[unit] = self._encode(unit)
        return ids


class Encoder:
    """Texts to ids. ``special``: the names of special tokens in a text become those tokens, as the library does if it is
    not told otherwise; else they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._names = self._added if special else []
        self._model = self._tokenizer.model

    def _library(self, text: str) -> array:
        return array("I", self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _named(self, texts: pa.Array) -> pa.Array:
        out = pa.array(np.zeros(len(texts), bool))
        for name in self._names:
            out = pc.or_(out, pc.match_substring(texts, name))
        return out

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` after it, one after another as unsigned 32-bit integers, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        out, counts, at = array("I"), [], 0
        for text, whole in zip(texts.to_pylist(), self._uncut(texts).to_pylist()):
            out.frombytes(memoryview(self._library(text) if whole else self.encode(text)).cast("B"))
            out.append(end_id)
            counts.append(len(out) - at)
            at = len(out)
        return np.frombuffer(out, np.uint32), np.array(counts, np.int64)


class UnitEncoder(Encoder):
    """A tokenizer that lower-cases and drops white space."""

    def __init__(self, path: str, special: bool = True):
        super().__init__(path, special)
        self._uncut = self._named
        self._words_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self._shown = byte_alphabet()
        self._word = _Units(self._encode_word)
        self._held = _Units(self._encode_unit)

    def _encode_word(self, word: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._shown))]).tobytes()

    def _encode_unit(self, unit: str) -> bytes:
        if not unit.isascii() and (max(unit) >= _PLAIN_BELOW or "\u0130" in unit):
            return self._library(unit).tobytes()
        if unit.isalpha():
            word = unit.lower()
            return array("I", [t.id for t in self._model.tokenize(word)]).tobytes() if word.isascii() else self._encode_word(word)
        if unit[-1:] in STOPS and unit[:-1].isalpha():
            return self._held[unit[:-1]] + self._word[unit[-1]]
        if _CONTROLS.search(unit):
            return self._library(unit).tobytes()
        return b"".join([self._word[w] for w in self._words_of(unit.lower())])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._held.__getitem__, text.replace("\n", " ").split(" ")))


class ByteEncoder(Encoder):
    """A byte-level tokenizer that keeps white space."""

    def __init__(self, path: str, special: bool = True):
        import tiktoken

        super().__init__(path, special)
        byte = {shown: b for b, shown in byte_alphabet().items()}
        vocabulary = {t: i for t, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if t not in self._added}
        self._alike = all(len(x) == 1 and x[0].id == i for t, i in vocabulary.items() for x in [self._model.tokenize(t)])
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items()} if self._alike else {bytes([b]): b for b in range(256)}
        self._encode = tiktoken.Encoding("own", pat_str=_BYTE_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _uncut(self, texts: pa.Array) -> pa.Array:
        return pc.or_(self._named(texts), pc.invert(pc.match_substring_regex(texts, _LATIN))) if self._alike else pa.array(np.ones(len(texts), bool))

    def encode(self, text: str) -> array:
        return array("I", self._encode(text))


@lru_cache(maxsize=2)
def encoder(path: str, bytes_matter: bool) -> Encoder:
    """``bytes_matter``: a byte-level tokenizer that keeps white space; else one that lower-cases and drops it."""
    return ByteEncoder(path) if bytes_matter else UnitEncoder(path)
