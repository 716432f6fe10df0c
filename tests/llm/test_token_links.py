"""Links of two tokenizers against a walk over every text's tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from meterline.llm import token_links
from meterline.llm.shared import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACED = ["  two  spaces ", "tab\t and \n line\n\nend ", " ", "\n", "a", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café 北京 🙂🙂 don't", "x" * 300, "un▁der", "  　wide", "\x00 nul", "12345 + 67.8 = ?!", "ends\r\n", "é ́x"]


def walk(texts):
    """Each text's numbers, by comparing all tokens of A and B in it."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    byte = {shown: b for b, shown in token_links.byte_alphabet().items()}
    parsed = []
    for text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False)
        a = list(zip(a.ids, (bytes(byte[c] for c in t) for t in a.tokens)))
        b = [(i, bytes([i - b_model.piece_to_id("<0x00>")]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text or "")]
        whole = (" " + (text or "")).encode()
        parsed.append((a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], []))
    counts, found = Counter(), []
    for a, b in parsed:
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, data in side:
                out.append((i, at, at + len(data)))
                at += len(data)
            spans.append(out)
        links, first = [], 0
        for i, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s, e in side if low <= s < high) for side in spans) for low, high in zip([0, *cuts], cuts)]
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest) for n_a, n_b, n_groups, links, digest in found]


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = walk([r.text for r in docs])
    assert rows_of(token_links.op12_token_links(spark, sf)) == sorted(((r.doc_id, *w) for r, w in zip(docs, want)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_and_clashing_columns(spark, small, monkeypatch):
    if small:
        for name in ("BATCH_BYTES", "BLOCK_BYTES", "GROUP_BYTES", "STEP_BYTES"):
            monkeypatch.setattr(token_links, name, 40)
    texts = [None, "", *SPACED, *SPACED[:3], "words again and again " * 400]
    docs = [(None if i % 5 == 0 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, pair long, part string")
    want = walk(texts)
    assert rows_of(token_links.link_documents(frame, A, B)) == sorted(((r[0], *w) for r, w in zip(docs, want)), key=str)


def test_empty_table(spark):
    assert token_links.link_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_aligned_tokens_give_the_same_groups(spark, sf):
    texts = [None, "", *SPACED, "words again " * 50]
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))

    def joined(r):
        groups = max(r.a_groups, default=-1) + 1
        sides = [[",".join(str(i) for i, g in zip(ids, of) if g == k) for k in range(groups)] for ids, of in ((r.a_ids, r.a_groups), (r.b_ids, r.b_groups))]
        return ";".join(map("|".join, zip(*sides)))

    want = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.groups_sha256) for r in token_links.link_documents(docs, A, B).collect()}
    got = {r.doc_id: (len(r.a_ids), len(r.b_ids), max(r.a_groups, default=-1) + 1, hashlib.sha256(text.encode()).hexdigest() if (text := joined(r)) else "") for r in token_links.aligned(docs, A, B).collect()}
    assert got == want
