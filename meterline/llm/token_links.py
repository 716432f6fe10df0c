"""Links between the tokens of two tokenizers over the same bytes, and how often each pair of ids is linked in the corpus.

Tokenizer A sees a space and the text; B adds that space itself. All tokens of both are sorted by their first byte, ends are
accumulated as running maxima, and a group breaks where a token starts at the running maximum: there, tokens of both
end. Within groups every token is linked with each token of the other side whose bytes overlap with its own.

Neither tokenizer joins anything across a space before a word, which is checked in the vocabularies, so texts are cut there and each distinct
unit of a block is encoded and aligned once; texts in which a space meets other white space stay whole. A task writes
blocks of about ``BLOCK_BYTES`` of text: the numbers of each text's units, each unit's pairs of ids, and the block's count of each distinct
pair. Blocks are dealt into groups by their number, in which pairs are counted again before they are summed over the corpus; counts meet
each group in a cogroup. Only the highest count of each B id is broadcast: one number for each entry of B's vocabulary, whose size is checked.

Defined results: texts that are null or empty, or whose tokens don't spell the space and the text in either tokenizer, have no tokens: numbers are zero
and groups ''; repeated rows count and are returned each; an empty table gives an empty one; columns other than ``doc_id`` and
``text`` are ignored. Texts of any length are taken whole; a text larger than a block is a block of its own, and is aligned in
steps where it can be cut at spaces.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.byte_bpe import pressed, unpressed
from meterline.llm.shared import arrow_schema, as_bytes, as_table, documents, release, slices, whole_texts, written
from meterline.llm.tokens import byte_alphabet, cut_at_spaces, gathered, space_meets_white

#: Text of a batch, of a block, and of a group of blocks, about.
BATCH_BYTES, BLOCK_BYTES, GROUP_BYTES = 4 << 20, 16 << 20, 32 << 20
#: Units, in bytes, that are encoded and aligned at once.
STEP_BYTES = 1 << 20
#: Vocabularies have no more entries than this, so that a pair fits in 42 bits and the table of highest counts can be broadcast.
MOST_ENTRIES = 1 << 21
PAIR = MOST_ENTRIES
BLOCK = "block long, texts binary, units binary, pairs array<long>, counts array<long>, bytes long"
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokens(NamedTuple):
    """Tokens of several texts: ids one after another, their sizes in bytes, and each text's number of tokens."""

    ids: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    #: Texts whose tokens spell them.
    whole: np.ndarray


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; names of special tokens in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        byte = {shown: b for b, shown in byte_alphabet().items()}
        added = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self._tokenizer.get_vocab()
        self.entries = max(vocabulary.values()) + 1
        self.pieces = [b""] * self.entries
        for token, i in vocabulary.items():
            self.pieces[i] = token.encode() if token in added else bytes(map(byte.__getitem__, token))
        #: Whether nothing but white space is ever joined with a space after it.
        self.cuts = all(b" " not in p[1:] or p.decode(errors="replace").isspace() for p in self.pieces)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """A tokenizer of the sentencepiece library that adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = self._model.vocab_size()
        names = self._model.id_to_piece(list(range(self.entries)))
        self.pieces = [bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cuts = all("▁" not in n[1:] or not n.strip("▁") for n in names)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    found = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    if found.entries > MOST_ENTRIES:
        raise ValueError(f"{path} has more than {MOST_ENTRIES} entries")
    return found


def tokens_of(path: str, texts: list[str]) -> Tokens:
    """The tokens of a space and each text."""
    coder = tokenizer(path)
    found = coder.ids_of(texts)
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter((i for x in found for i in x), np.int64, int(counts.sum()))
    piece = coder.pieces.__getitem__
    whole = np.fromiter((b"".join(map(piece, x)) == b" " + t.encode() for x, t in zip(found, texts)), bool, len(texts))
    return Tokens(ids, np.fromiter(map(len, coder.pieces), np.int64, coder.entries)[ids], counts, whole)


class Alignment(NamedTuple):
    """Two tokenizations of the same bytes. Tokens of A and B lie in order; ``a_groups`` and ``b_groups`` are their groups' numbers; links are pairs of token numbers."""

    a_groups: np.ndarray
    b_groups: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Alignment:
    """Groups and links of tokens that cover the same bytes without gaps, by interval coalescing."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_start, b_start = a_end - a_sizes, b_end - b_sizes
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_end), start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.append(False, start[order][1:] >= reached[:-1]) if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    # overlaps expand: the tokens of B that end after a token of A starts and start before it ends
    low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
    count = high - low
    a_links = np.repeat(np.arange(len(a_end)), count)
    b_links = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    return Alignment(group[: len(a_end)], group[len(a_end) :], a_links, b_links)


class Units(NamedTuple):
    """What is known of each distinct unit: counts of tokens, groups and links, its groups as text (None: its tokens don't spell it), and its pairs of ids, one after another."""

    numbers: np.ndarray
    texts: list[str | None]
    pairs: np.ndarray


def _steps(texts: list[str]):
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and held > STEP_BYTES:
            yield texts[at:i]
            at, held = i, 0
        held += len(t) + 1
    if texts[at:]:
        yield texts[at:]


def align_units(texts: list[str], a_path: str, b_path: str) -> Units:
    numbers, shown, pairs = [], [], []
    for some in _steps(texts):
        a, b = tokens_of(a_path, some), tokens_of(b_path, some)
        good = a.whole & b.whole
        a_in, b_in = np.repeat(good, a.counts), np.repeat(good, b.counts)
        a_ids, b_ids = a.ids[a_in], b.ids[b_in]
        found = align(a.sizes[a_in], b.sizes[b_in])
        n_a, n_b = a.counts[good], b.counts[good]
        a_begin, b_begin = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        groups = found.a_groups[a_begin[1:] - 1] - found.a_groups[a_begin[:-1]] + 1
        links = np.bincount(found.a_links, minlength=len(a_ids))
        links = np.concatenate([[0], np.cumsum(links)])
        rows = np.zeros((len(some), 4), np.int64)
        rows[good] = np.column_stack([n_a, n_b, groups, links[a_begin[1:]] - links[a_begin[:-1]]])
        numbers.append(rows)
        pairs.append(a_ids[found.a_links] * PAIR + b_ids[found.b_links])
        sides = [_joined(ids, group) for ids, group in ((a_ids, found.a_groups), (b_ids, found.b_groups))]
        both = [f"{x}|{y}" for x, y in zip(*sides)]
        ends = np.cumsum(groups).tolist()
        text = iter([";".join(both[x:y]) for x, y in zip([0, *ends], ends)])
        shown += [next(text) if g else None for g in good.tolist()]
    return Units(np.concatenate(numbers) if numbers else np.empty((0, 4), np.int64), shown, np.concatenate(pairs) if pairs else np.empty(0, np.int64))


def _joined(ids: np.ndarray, group: np.ndarray) -> list[str]:
    """The ids of each group, joined by commas."""
    edges = np.searchsorted(group, np.arange((int(group[-1]) if len(group) else -1) + 2)).tolist()
    names = list(map(str, ids.tolist()))
    return [names[x] if y - x == 1 else ",".join(names[x:y]) for x, y in zip(edges, edges[1:])]


class _Block:
    """Texts as numbers of the block's distinct units."""

    def __init__(self, a_path: str, b_path: str):
        self._paths = a_path, b_path
        self._cuts = tokenizer(a_path).cuts and tokenizer(b_path).cuts
        self._begin()

    def _begin(self) -> None:
        self._known: dict[str, int] = {}
        self._units: list[Units] = []
        self._texts: list[dict[str, pa.Array]] = []
        self._numbers: list[np.ndarray] = []
        self.size = 0

    @property
    def filled(self) -> bool:
        return bool(self._texts)

    def add(self, batch: pa.RecordBatch) -> None:
        texts = batch.column("text")
        padded = pc.binary_join_element_wise("", texts, "", " ")  # white space at either end meets a space, too
        uncut = space_meets_white(padded) if self._cuts else pa.array(np.ones(len(texts), bool))
        cut = cut_at_spaces(texts, pc.and_(uncut, pc.not_equal(texts, "")))
        names = [*cut.rest.to_pylist(), *cut.first.to_pylist(), *cut.whole]
        place = np.fromiter((self._known.setdefault(t, len(self._known)) for t in names), np.int64, len(names))
        before = sum(len(u.texts) for u in self._units)
        new = list(self._known)[before:]
        self._units.append(align_units(new, *self._paths))
        numbers = place[cut.numbers]
        counts = np.diff(cut.begins)
        shown = [t for u in self._units for t in u.texts]
        of = np.concatenate([u.numbers for u in self._units])
        filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        spelled = np.fromiter((t is not None for t in shown), bool, len(shown))
        good = filled & np.logical_and.reduceat(spelled[numbers], cut.begins[:-1])
        sums = np.add.reduceat(of[numbers], cut.begins[:-1], axis=0) * good[:, None]
        begins, listed = cut.begins.tolist(), numbers.tolist()
        digests = [hashlib.sha256(";".join([shown[k] for k in listed[x:y]]).encode()).hexdigest() if g else "" for x, y, g in zip(begins, begins[1:], good.tolist())]
        kept = np.repeat(good, counts)
        self._texts.append({"doc_id": batch.column("doc_id"), **{n: pa.array(sums[:, k]) for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": pa.array(digests, pa.string()), "units": pa.array(counts * good)})
        self._numbers.append(numbers[kept].astype(np.uint32))
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0

    def end(self) -> list:
        """The columns of ``BLOCK`` without the block's number."""
        of = np.concatenate([u.numbers[:, 3] for u in self._units])
        pairs = np.concatenate([u.pairs for u in self._units])
        used = np.bincount(np.concatenate(self._numbers), minlength=len(of))
        distinct, place = np.unique(pairs, return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(used, of), minlength=len(distinct)).astype(np.int64)
        there = counts > 0
        texts = pa.Table.from_batches([pa.record_batch(t) for t in self._texts]).combine_chunks()
        texts = as_bytes({n: texts[n].combine_chunks() if len(texts) else pa.array([], texts.schema.field(n).type) for n in texts.column_names})
        # frequent units get small numbers
        order = np.argsort(-used, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        links = gathered(order, np.cumsum(of) - of, of, place)[0]
        units = as_bytes({"numbers": pa.array([pressed(rank[np.concatenate(self._numbers)])], pa.binary()), "links": pa.array([pressed(of[order])], pa.binary()), "pairs": pa.array([pressed((np.cumsum(there) - 1)[links].clip(0))], pa.binary())})
        row = [texts, units, distinct[there], counts[there], self.size]
        self._begin()
        return row


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Aligned texts in blocks (``BLOCK``), written once, so that a retried task finds the pairs that were counted."""
    fields = BLOCK.split(", ", 1)[1]
    schema = arrow_schema(fields)

    def work(batches):
        block = _Block(a_path, b_path)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(block.end(), schema)], schema=schema)

        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                size = pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                if block.filled and block.size + size > BLOCK_BYTES:
                    yield row()
                    release()
                block.add(some)
        if block.filled:
            yield row()
        release()

    return written(docs.mapInArrow(work, fields).select(F.monotonically_increasing_id().alias("block"), "*"), "links", compression="uncompressed")


def pair_counts(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, pair, n): how often each pair is linked in a group of blocks; (pair, count): in the corpus."""
    listed = dealt.select("part", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("part", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    asked = written(listed.groupBy("part", "pair").agg(F.sum("n").alias("n")), "asked")
    return asked, written(asked.groupBy("pair").agg(F.sum("n").alias("count")), "counts")


def link_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``LINKED`` of every document: its tokens, groups and links; ``n_best``, its links whose pair's count is the highest of the pair's B id in the corpus; ``count_sum``, the counts of all its links."""
    dealt = blocks(whole_texts(docs), a_path, b_path)
    parts = max(1, (dealt.agg(F.sum("bytes")).first()[0] or 0) // GROUP_BYTES)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    asked, counts = pair_counts(dealt)
    best = counts.groupBy(F.pmod("pair", F.lit(PAIR)).alias("b")).agg(F.max("count").alias("most"))
    rated = counts.join(F.broadcast(best), F.pmod("pair", F.lit(PAIR)) == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = asked.select("part", "pair").join(rated, "pair")
    schema = arrow_schema(LINKED)

    def answer(key, group: pa.Table, told: pa.Table) -> pa.Table:
        pair = told["pair"].to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], told["count"].to_numpy()[order], told["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        out = []
        for texts, units, own in zip(group["texts"], group["units"], group["pairs"]):
            texts, units, own = as_table(texts.as_py()), as_table(units.as_py()), own.values.to_numpy()
            place = np.searchsorted(pair, own)
            if len(own) and (place.max() >= len(pair) or (pair[place] != own).any()):
                raise KeyError("a pair of the block was not counted")
            numbers, links, pairs = (unpressed(units[n][0].as_py()) for n in ("numbers", "links", "pairs"))
            ends = np.concatenate([[0], np.cumsum(links)])
            at_text = np.concatenate([[0], np.cumsum(texts["units"].to_numpy())])
            sums = []
            for values in (best, count):
                total = np.concatenate([[0], np.cumsum(values[place][pairs] if len(own) else np.zeros(len(pairs), np.int64))])
                each = np.concatenate([[0], np.cumsum((total[ends[1:]] - total[ends[:-1]])[numbers])])
                sums.append(pa.array(each[at_text[1:]] - each[at_text[:-1]]))
            out.append(pa.Table.from_arrays([*(texts[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, texts["groups_sha256"]], schema=schema))
        release()
        return pa.concat_tables(out) if out else schema.empty_table()

    return dealt.select("part", "texts", "units", "pairs").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(answer, LINKED)


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``ALIGNED`` of every document: the ids of both tokenizers, and for each token the number, from 0, of the group that it belongs to in its text. Without tokens, lists are empty."""
    schema = arrow_schema(ALIGNED)

    def work(batches):
        for batch in batches:
            for some in slices(batch, "text", STEP_BYTES):
                texts = some.column("text").to_pylist()
                a, b = tokens_of(a_path, texts), tokens_of(b_path, texts)
                good = a.whole & b.whole & np.fromiter(map(bool, texts), bool, len(texts))
                a_in, b_in = np.repeat(good, a.counts), np.repeat(good, b.counts)
                found = align(a.sizes[a_in], b.sizes[b_in])
                ends = [np.cumsum(x.counts * good) for x in (a, b)]
                offsets = [pa.array(np.concatenate([[0], e]), pa.int32()) for e in ends]
                # groups are numbered on through the batch
                first = np.append(found.a_groups, 0)[np.concatenate([[0], ends[0][:-1]])]
                groups = [g - np.repeat(first[good], x.counts[good]) for g, x in ((found.a_groups, a), (found.b_groups, b))]
                lists = [pa.ListArray.from_arrays(o, pa.array(v, pa.int32())) for o, v in zip((*offsets, *offsets), (a.ids[a_in], b.ids[b_in], *groups))]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(x.cast(f.type) for x, f in zip(lists, list(schema)[1:]))], schema=schema)
            release()

    return whole_texts(docs).mapInArrow(work, ALIGNED)


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
