"""Byte-level BPE by ranks, encoding and decoding.

Texts are cut into words by the tokenizer's pattern, and stored in blocks as numbers of the block's distinct words.
The distinct words of all blocks are encoded by Spark's
higher-order functions, which fold merges over a word's bytes, lowest rank first and
leftmost among equals, looking ranks up in a literal map; the answers meet the block's
numbers in a cogroup. Bytes are written as the characters U+0000 to U+00FF inside Spark,
so that a piece is a string and joining pieces is ``concat``. Words of more than ``LONG_WORD`` bytes, which are rare, are merged with the help
of a heap in Arrow tasks.

Blocks are written once, so that a retried task finds what was asked for; a word without an answer is an error. What a
block asks of a bucket of words, and what it is answered, are one compressed row each. Of more than ``GROUP`` blocks, those of a group are first
made one asker for each bucket: a word that all blocks hold then comes to its task once a group, each task's rows are bounded by the
groups, and rows grow with the blocks, and with the square of the groups, which are few.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded each; an empty table gives an empty one; columns other than ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.shared import ZSTD_LEVEL, arrow_schema, as_bytes, as_table, documents, let, release, slices, whole_texts, written
from meterline.llm.tokens import STOPS, cut_at_spaces, gathered, space_meets_white

#: Buckets of the literal rank map, so that a lookup compares a few keys.
BUCKETS = 8192
NO_RANK = 2**31 - 1
#: Text of a block, and of a batch that is cut at once.
BLOCK_BYTES, BATCH_BYTES = 32 << 20, 16 << 20
#: Bytes of a word above which the fold, whose time grows with the square of them, gives way to a heap.
LONG_WORD = 128
#: Places of a word in one row, and answers that a task gathers before it writes them.
ASKERS, HELD_ANSWERS = 10_000, 500_000
#: Ids, in bytes, that are decoded at once.
DECODED_BYTES = 4 << 20
ENCODED = "doc_id long, n_tokens long, ids binary"
ANSWERS = "asked_by long, places binary, sizes binary, ids binary"
#: Buckets of words that blocks ask, and blocks of a group: a bucket gets some thousand words of each of so many blocks, and a row has enough of them to be worth compressing.
WORD_BUCKETS, GROUP = 64, 256

#: Unicode's White_Space property, as the tiktoken library reads \s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def rank_map(path: str) -> Column:
    """A literal array of maps from piece to rank; a piece's place is a hash of it."""
    held: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in read_ranks(path).items():
        key = piece.decode("latin-1")
        held[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def encode_word(word: Column, ranks: Column) -> Column:
    """The ids of one word of byte characters."""
    none = F.array().cast("array<int>")

    def rank(piece: Column) -> Column:
        bucket = F.get(ranks, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int"))
        return F.coalesce(F.element_at(bucket, piece), F.lit(NO_RANK))

    def merged(held: Column, p: Column) -> Column:
        """The state after joining the p-th part, from 1, with the next."""
        parts, found = held["parts"], held["found"]
        n = F.size(parts)

        def with_made(made: Column) -> Column:
            left = F.when(p > 1, F.array(rank(F.concat(F.get(parts, p - 2), made)))).otherwise(none)
            right = F.when(p + 1 < n, F.array(rank(F.concat(made, F.get(parts, p + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), p - 1), F.array(made), F.slice(parts, p + 2, F.greatest(n - p - 1, F.lit(0)))).alias("parts"),
                F.concat(F.slice(found, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(found, p + 2, F.greatest(n - p - 2, F.lit(0)))).alias("found"),
            )

        return let(F.concat(F.get(parts, p - 1), F.get(parts, p)), with_made)

    def merge(held: Column, _: Column) -> Column:
        # leftmost of the lowest ranks; nothing is left to join where none has a rank
        def at(best: Column) -> Column:
            return F.when(best < NO_RANK, let(F.array_position(held["found"], best).cast("int"), lambda p: merged(held, p))).otherwise(held)

        return let(F.array_min(held["found"]), at)

    steps = F.length(word) - 1
    pairs = F.transform(F.sequence(F.lit(1), steps), lambda i: rank(F.substring(word, i, F.lit(2))))
    folded = F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.split(word, "").alias("parts"), pairs.alias("found")), merge, lambda held: held["parts"])
    # a word that is a piece itself needs no merges
    parts = F.when(rank(word) < NO_RANK, F.array(word)).otherwise(folded)
    return F.transform(parts, rank)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word by the same merges; a heap holds the pairs, so that time grows with n log n."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    alive = bytearray(b"\x01" * n)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue  # one of the two was joined with another
        alive[j] = 0
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(word[left : ends[right]])) is not None:
                heappush(heap, (r, left, ends[right]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


class Words:
    """Cuts texts into words: first at spaces, then each distinct unit once by the pattern. Words come as byte characters."""

    def __init__(self, pattern: str):
        self._find = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall

    def of(self, text: str) -> list[str]:
        return [w if w.isascii() else w.encode().decode("latin-1") for w in self._find(text)]

    def of_unit(self, unit: str, lead: str) -> list[str]:
        if unit.isascii():
            if unit.isalpha():
                return [lead + unit]
            if unit[-1:] in STOPS and unit[:-1].isalpha():
                return [lead + unit[:-1], unit[-1]]
        return self.of(lead + unit)


def pressed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**30, compressed: seven bits of each, then the next seven of those that have more, then the rest; bits of like weight go together."""
    numbers = np.ascontiguousarray(numbers, np.uint32)
    second = numbers[numbers >= 1 << 7]
    third = second[second >= 1 << 14]
    planes = (numbers & 127 | (numbers >= 1 << 7) * 128).astype(np.uint8), (second >> 7 & 127 | (second >= 1 << 14) * 128).astype(np.uint8), (third >> 14).astype("<u2")
    return struct.pack("<QQ", len(numbers), len(second)) + zstandard.compress(b"".join(x.tobytes() for x in planes), ZSTD_LEVEL)


def unpressed(data: bytes) -> np.ndarray:
    n, m = struct.unpack_from("<QQ", data)
    planes = zstandard.decompress(memoryview(data)[16:])
    out, second, third = np.frombuffer(planes, np.uint8, n).astype(np.int64), np.frombuffer(planes, np.uint8, m, n).astype(np.int64), np.frombuffer(planes, "<u2", -1, n + m)
    longer = second >= 128
    second[longer] += (third.astype(np.int64) << 7) - 128
    longer = out >= 128
    out[longer] += (second << 7) - 128
    return out


def numbered(docs: DataFrame, pattern: str) -> DataFrame:
    """Blocks of whole texts as numbers of their words, the block's most frequent first and the others in order: for each of some pieces, ``doc_ids``, ``counts``, each text's number of
    words, and ``numbers``, all their words, compressed; and ``words``, the block's distinct words in the order of their numbers, as a compressed Arrow array.
    """
    ddl = "doc_ids array<array<long>>, counts array<binary>, numbers array<binary>, words binary"
    schema = arrow_schema(ddl)

    def number(batches):
        cut = Words(pattern)
        known: dict[str, int] = {}
        doc_ids, counts, numbers, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            seen = sum(np.bincount(x, minlength=len(known)) for x in numbers)
            words = pa.array(list(known), pa.string())
            # frequent words get short numbers; the others are in order, which compresses well
            place = np.empty(len(words), np.int64)
            place[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            often = np.argsort(-seen, kind="stable")[: 1 << 14]
            place[often] = np.arange(-len(often), 0)
            order = np.argsort(place)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = words.take(pa.array(order))
            row = [[x.to_pylist() for x in doc_ids], [pressed(x) for x in counts], [pressed(rank[x]) for x in numbers], as_bytes({"word": words})]
            known.clear(), doc_ids.clear(), counts.clear(), numbers.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                texts = some.column("text")
                held = pc.sum(pc.binary_length(texts)).as_py() or 0
                if doc_ids and size + held > BLOCK_BYTES:
                    yield block()
                    size = 0
                size += held
                units = cut_at_spaces(texts, space_meets_white(texts))
                places, starts = array("i"), [0]
                for lead, group in ((" ", units.rest.to_pylist()), ("", units.first.to_pylist()), (None, units.whole)):
                    for unit in group:
                        for w in cut.of(unit) if lead is None else cut.of_unit(unit, lead):
                            places.append(known.setdefault(w, len(known)))
                        starts.append(len(places))
                begins = np.array(starts, np.int64)
                found, n = gathered(units.numbers, begins[:-1], np.diff(begins), np.frombuffer(places, np.int32) if places else np.empty(0, np.int32))
                of_text = np.add.reduceat(n, units.begins[:-1])
                ends = np.cumsum(of_text)
                # a piece has about a quarter of the batch's words
                edges = np.unique(np.searchsorted(ends, np.arange(1, 4) * (len(found) // 4)))
                for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(of_text)]):
                    if first < last:
                        doc_ids.append(some.column("doc_id").slice(first, last - first))
                        counts.append(of_text[first:last])
                        numbers.append(found[ends[first] - of_text[first] : ends[last - 1]])
        if doc_ids:
            yield block()
        release()

    return docs.mapInArrow(number, ddl).select(F.monotonically_increasing_id().alias("block"), "*")


def asks(dealt: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, places, words): what each of the rows of ``dealt`` (block, words) asks of a bucket of words, in one compressed row; words are dealt into buckets by their hash."""
    ddl = "bucket int, block long, places binary, words binary"
    schema = arrow_schema(ddl)

    def ask(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = as_table(data.as_py())["word"].combine_chunks()
                bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words.to_pylist()), np.int32, len(words))
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                rows = [(k, block, pressed(np.diff(at, prepend=0)), as_bytes({"word": words.take(pa.array(at))})) for k, at in zip(found.tolist(), np.split(order, first[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, schema)], schema=schema)
                del words, bucket, order, rows
                release()

    return dealt.select("block", "words").mapInArrow(ask, ddl)


class Asked:
    """The distinct words of some rows of :func:`asks`, and for each its askers and their places, one after another."""

    def __init__(self, group: pa.Table):
        words = [as_table(x.as_py())["word"].combine_chunks() for x in group["words"]]
        coded = pa.concat_arrays(words).dictionary_encode()
        numbers = coded.indices.to_numpy()
        order = np.argsort(numbers, kind="stable")
        self.words = coded.dictionary
        self.counts = np.bincount(numbers, minlength=len(self.words))
        self.blocks = np.repeat(group["block"].to_numpy(), list(map(len, words)))[order]
        self.places = np.concatenate([np.cumsum(unpressed(x.as_py())) for x in group["places"]])[order]


def distinct_words(dealt: DataFrame, buckets: int, path: str) -> DataFrame:
    """(word, long, blocks, places): each distinct word and where it is asked for, at most ``ASKERS`` places a row; ``long`` has the ids of a long word."""
    ddl = "word string, long array<int>, blocks array<long>, places array<int>"
    schema = arrow_schema(ddl)

    def gather(group: pa.Table) -> pa.Table:
        release()
        asked = Asked(group)
        rows = -(-asked.counts // ASKERS)
        ends = np.repeat(np.cumsum(asked.counts), rows)
        place = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        begins = np.minimum(np.repeat(np.cumsum(asked.counts) - asked.counts, rows) + place * ASKERS, ends)
        offsets = pa.array(np.concatenate([begins, [len(asked.places)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x).cast(f.type.value_type)).cast(f.type) for x, f in zip((asked.blocks, asked.places), list(schema)[2:])]
        distinct = asked.words.take(pa.array(np.repeat(np.arange(len(asked.counts)), rows)))
        long_words = pc.greater(pc.utf8_length(distinct), LONG_WORD).to_pylist()
        ids = [merge_long(distinct[i].as_py().encode("latin-1"), read_ranks(path)) if x else None for i, x in enumerate(long_words)]
        return pa.Table.from_arrays([distinct, pa.array(ids, schema.field("long").type), *lists], schema=schema)

    return asks(dealt, buckets).groupBy("bucket").applyInArrow(gather, ddl)


def first_asks(dealt: DataFrame, groups: int) -> DataFrame:
    """(block, words, counts, blocks, places): of each bucket and group of blocks, the distinct words that the blocks ask for, as one asker of them all, and where each word is asked for."""
    ddl = "block long, words binary, counts binary, blocks binary, places binary"
    schema = arrow_schema(ddl)

    def gather(key, group):
        release()
        asked = Asked(group)
        row = (key[0].as_py() * groups + key[1].as_py(), as_bytes({"word": asked.words}), pressed(asked.counts), zstandard.compress(asked.blocks.astype("<i8").tobytes(), ZSTD_LEVEL), pressed(asked.places))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    found = asks(dealt, WORD_BUCKETS).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    return written(found.groupBy("bucket", "part").applyInArrow(gather, ddl), "asked", compression="uncompressed")


def passed_on(askers: DataFrame, answers: DataFrame) -> DataFrame:
    """What the askers of :func:`first_asks` were answered, as answers to the blocks that had asked them."""
    schema = arrow_schema(ANSWERS)

    def expand(key, group, told):
        out = []
        for row in group.to_pylist():
            starts, sizes, pool = _told(told)
            counts, places = unpressed(row["counts"]), unpressed(row["places"])
            blocks = np.frombuffer(zstandard.decompress(row["blocks"]), "<i8")
            if len(sizes) < len(counts) or sizes[: len(counts)].min(initial=0) < 0:
                raise KeyError("a word of an asker was not answered")
            word = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((places, blocks))
            found, first = np.unique(blocks[order], return_index=True)
            out += [(k, pressed(np.diff(places[x], prepend=0)), pressed(sizes[word[x]]), pressed(gathered(word[x], starts, sizes, pool)[0])) for k, x in zip(found.tolist(), np.split(order, first[1:]))]
        release()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 4, schema)], schema=schema)

    return askers.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(expand, ANSWERS)


def _told(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of ``ANSWERS``, for each place where its ids begin, how many they are (-1: no answer), and all ids."""
    at, sizes_of, ids = (np.concatenate([f(unpressed(x.as_py())) for x in told[c]] or [np.empty(0, np.int64)]) for c, f in (("places", np.cumsum), ("sizes", np.asarray), ("ids", np.asarray)))
    known = int(at.max(initial=-1)) + 1
    starts, sizes = np.zeros(known, np.int64), np.full(known, -1, np.int64)
    starts[at], sizes[at] = np.cumsum(sizes_of) - sizes_of, sizes_of
    return starts, sizes, ids.astype("<u4")


def by_block(answers: DataFrame) -> DataFrame:
    """(asked_by, places, sizes, ids): answers of some words to a block in one row, compressed; places as steps from one to the next."""
    schema = arrow_schema(ANSWERS)

    def pack(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def rows() -> pa.RecordBatch:
            blocks, places, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
            pool, starts = np.concatenate([h[3] for h in held]), np.zeros(len(sizes), np.int64)
            at = base = 0
            for b, _, n, ids in held:
                # each asker of a word gets the same ids
                starts[at : at + len(b)] = base + n[:, 1]
                at, base = at + len(b), base + len(ids)
            n = sizes[:, 0]
            order = np.lexsort((places, blocks))
            found, first = np.unique(blocks[order], return_index=True)
            out = [(k, pressed(np.diff(places[x], prepend=0)), pressed(n[x]), pressed(gathered(x, starts, n, pool)[0])) for k, x in zip(found.tolist(), np.split(order, first[1:]))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            blocks, places, ids = batch.columns
            if not len(blocks):
                continue
            askers = np.diff(blocks.offsets.to_numpy())
            begins = ids.offsets.to_numpy().astype(np.int64)
            each = np.column_stack([np.diff(begins), begins[:-1] - begins[0]])
            held.append((blocks.flatten().to_numpy(), places.flatten().to_numpy().astype(np.int64), np.repeat(each, askers, axis=0), ids.flatten().to_numpy()))
            count += int(askers.sum())
            if count > HELD_ANSWERS:
                yield rows()
                count = 0
        if held:
            yield rows()
        release()

    return answers.select("blocks", "places", "ids").mapInArrow(pack, ANSWERS)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit) of every document."""
    dealt = written(numbered(whole_texts(docs), pattern), "numbers", compression="uncompressed")
    answered = arrow_schema(ENCODED)

    def answer(key, group, told):
        starts, sizes, pool = _told(told)
        rows = []
        for doc_ids, counts, numbers in zip(*(group[c].combine_chunks().flatten() for c in ("doc_ids", "counts", "numbers"))):
            n, numbers = unpressed(counts.as_py()), unpressed(numbers.as_py())
            if len(numbers) and (numbers.max() >= len(sizes) or sizes[numbers].min() < 0):
                raise KeyError("a word of the block was not asked for")
            values, each = gathered(numbers, starts, sizes, pool)
            # a text without words has no ids
            tokens = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n)])])
            bounds = 4 * np.concatenate([[0], np.cumsum(tokens)])
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
            rows.append(pa.RecordBatch.from_arrays([doc_ids.values, pa.array(tokens), binary], schema=answered))
        release()
        return pa.Table.from_batches(rows, schema=answered)

    groups = -(-dealt.count() // GROUP)
    askers = first_asks(dealt, groups) if groups > 1 else dealt
    words = distinct_words(askers, WORD_BUCKETS * max(1, groups), path)
    # the map is named once, so that the plan holds it once
    ids = F.when(F.col("long").isNull(), let(rank_map(path), lambda ranks: encode_word(F.col("word"), ranks))).otherwise(F.col("long"))
    answers = by_block(words.select("blocks", "places", ids.alias("ids")))
    answers = passed_on(askers, answers) if groups > 1 else answers
    return dealt.drop("words").groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(answer, ENCODED)


def decode(tokens: DataFrame, path: str, keep: str = "doc_id long, n_tokens long, ids binary") -> DataFrame:
    """Adds ``decoded``: the binary pieces of ``ids``, concatenated."""
    ddl = f"{keep}, decoded binary"
    names, schema = [x.split()[0] for x in keep.split(", ")], arrow_schema(ddl)

    def concatenate(batches):
        piece = pieces(path).__getitem__
        for batch in batches:
            for some in slices(batch, "ids", DECODED_BYTES):
                out = pa.array([b"".join(map(piece, memoryview(x.as_buffer() if x.is_valid else b"").cast("I"))) for x in some.column("ids")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), out], schema=schema)
                del out
            release()

    return tokens.select(*names).mapInArrow(concatenate, ddl)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
