"""Each operator against a plain brute-force version, on test documents and on odd rows: nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import byte_bpe, chat_format, exact_topk, html_text, lm_score, near_dedup, packing, quality, secrets, token_output
from meterline.llm.tokens import encoder

DDL = "doc_id long, text string, lang string, source string, n_chars long, start long, component string, rules string, block int"
SHARED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [
    None, "", " ", "\n\t ", "word", SHARED, SHARED, SHARED + " extra", "İx Σ ß ﬁ ́a  b c \x1c d", "it's I'll 'Sx'  12 3 45² ½\r\n\r\n  end ", "password = hunter2hunter2 token:short secret: 'abcdefgh.ijk'",
    "AKIA" + "A1" * 8 + " AKIASHORT " + "0123456789abcdef" * 3 + " api_key=deadbeef" * 3, "😀 api-key \"api_key\": \"ABCDEFGH12345\" 😀", ("spam eggs ham " * 40).strip(), "ab" * 3000, "x " * 9000 + "the end", "pq" * 50_000, "<|endoftext|> in a text", "line one\nline one\n\nline two $#@ % & | <b>",
]


def odd_rows(spark):
    rows = [(k, t, "en", "src0", -1, 7, "c", "r", 3) for k, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id at all", None, None, None, None, None, None, None), (5, "the same id with another text", "en", "src0", 1, 1, "c", "r", 1)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(spark)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def tokenizer(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(P.path(name))
    return lambda text: found.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name, space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_encode_as_whole_texts(docs, odd, name, space):
    encode, own = tokenizer(name), encoder(P.path(name), space)
    more = [" lead", "a \n b", "x\n\ny z", "tab\t x", "ªb ºc. ǅx, ʰa", "a.b c,, d.", "<|endoftext|> <|startoftext|>x", "x<|EndOfText|>", "d'accord l'été, 'tis o'clock's", "中文 字符。 Ελλάδα Σ"]
    rng = np.random.default_rng(2)
    letters = [*" \n\t'.,!12aZéß€ªºǅ", "  ", "\r\n", "'s", " 'll", "it", "the", "<|endoftext|>"]
    more += ["".join(letters[k] for k in rng.integers(0, len(letters), n)) for n in rng.integers(1, 40, 2000)]
    texts = [t for _, t in pairs(odd)] + [t for _, t in pairs(docs)][:60] + more
    ids, counts = own.encode_batch(pa.array(texts), 0)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == [*encode(text), 0], text[:80]
        at += n


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    encode = tokenizer("word_bpe_49k.json")
    got = packing.packed_digest(df).collect()
    want = collections.Counter()
    total = 0
    for doc_id, text in pairs(df):
        ids = encode(text) + [0]
        total += len(ids)
        want.update((doc_id, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 2


def test_packing_rounds_merge_underfull_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    items = spark.range(400).select(F.col("id").alias("uid"), (F.col("id") * 37 % 900 + 1).cast("int").alias("length"))
    layout = packing.pack_layout(items).join(items, "uid").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r.n for r in layout)
    assert sum(1 for _ in layout) <= math.ceil(total / 2048) + 3 and max(r.n for r in layout) <= 2048
    assert packing.pack_layout(items.limit(0)).count() == 0


def plain_ppm(rows, k=lm_score.ORDER):
    tables = [collections.defaultdict(collections.Counter) for _ in range(k + 1)]

    def padded(text):
        return b"\xff" * k + text.encode().lower() + b"\xff"

    for doc_id, text in rows:
        if not lm_score.held_out(doc_id, 7, 2):
            b = padded(text)
            for j in range(k, len(b)):
                for n in range(k + 1):
                    tables[n][b[j - n : j]][b[j]] += 1

    def score(text):
        b, total = padded(text), 0.0
        for j in range(k, len(b)):
            gone = set()
            for n in range(k, -1, -1):
                seen = tables[n].get(b[j - n : j])
                if not seen:
                    continue
                left = {s: c for s, c in seen.items() if s not in gone}
                whole = 2 * sum(left.values())
                if b[j] in left:
                    total += math.log10((2 * left[b[j]] - 1) / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                gone |= set(seen)
            else:
                total -= math.log10(256 - len(gone))
        return total

    return score


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_lm_score(request, which):
    df = request.getfixturevalue(which)
    rows = pairs(df)
    counts = collections.Counter()
    for doc_id, text in rows:
        if not lm_score.held_out(doc_id, 7, 2):
            counts.update([*text.encode().lower().split(), None])
    n, v, model = sum(counts.values()), len(counts), plain_ppm(rows)
    want = collections.Counter()
    for doc_id, text in rows:
        tokens = [*text.encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want[doc_id, lm_score.held_out(doc_id, 7, 2), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4), round(model(text), 4)] += 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in lm_score.score(df).collect())
    assert got == want


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_byte_bpe(request, which):
    import tiktoken

    df = request.getfixturevalue(which)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = collections.Counter((r.doc_id, tuple(memoryview(r.ids).cast("I")) if r.ids else (), bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(df, path, P.PATTERN), path).collect())
    assert got == collections.Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in pairs(df))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_secrets(request, which):
    df = request.getfixturevalue(which)
    got = secrets.scan(df)
    assert got.columns == [*df.columns, "secret_spans"]
    held = collections.Counter((r.doc_id, r.text or "", tuple((s.start, s.place, s.kind, s.end) for s in r.secret_spans if s.place < 3)) for r in got.collect())
    assert held == collections.Counter((i, t, tuple(plain_spans(t))) for i, t in pairs(df))
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redacted_texts_have_no_secrets_and_clean_ones_stay(odd):
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns
    texts = [t for _, t in pairs(clean)]
    assert not any(plain_spans(t) for t in texts)
    assert collections.Counter(t for _, t in pairs(odd) if not plain_spans(t)) <= collections.Counter(texts)


def test_trigram_queries():
    assert secrets.trigram_query("abcd(e|f)?[0-9]+xyz") == {frozenset({"abc", "bcd", "xyz"})}
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query("(foo|ba)+bar") == secrets.ANY or frozenset({"bar"}) in secrets.trigram_query("(foo|ba)+bar")
    assert secrets.trigram_query("(?i)AKIA") == {frozenset({"aki", "kia"})}


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    repeats = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    failed = len(words) < 20 or 100 * len(repeats) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats), failed


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality(spark, sf, request, which):
    df = request.getfixturevalue(which)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated = quality.rate(df, labels).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rated)
    assert got == collections.Counter((i, *plain_statistics(t)) for i, t in pairs(df))
    assert not any(r.kept and r.base_failed for r in rated)
    if which == "docs":
        told = {r.doc_id: r.quality for r in labels.collect()}
        judged = [(told[r.doc_id], r.kept) for r in rated if r.doc_id in told and not r.base_failed]
        assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)


def test_quality_without_labels_is_the_base(spark, odd):
    rated = quality.rate(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept != r.base_failed for r in rated)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(800, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=800) < 0.1)).astype(float)
    trees = quality.fit(x, y, [-1, 0], trees=20)
    assert ((trees.score(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.9
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.3)])
    assert (np.diff(trees.score(grid)) <= 1e-12).all()


def test_flat_trees_score_as_a_walk_through_them():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(300, 3))
    trees = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] < 0.7).astype(float), [-1, 0, 0], trees=12)

    def walk(row, at):
        while trees.feature[at] >= 0:
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        return trees.value[at]

    assert np.allclose(trees.score(x), [trees.start + sum(walk(row, root) for root in trees.roots) for row in x])


def test_one_text_of_an_id_teaches_the_model_whatever_the_order(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    twice = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1).alias("doc_id"), "text"))
    a, b = (collections.Counter(map(tuple, quality.rate(d, labels).collect())) for d in (twice, twice.orderBy(F.desc("text"))))
    assert a == b


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "SLICE", 2)
    monkeypatch.setattr(exact_topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(500, 20)), 2)
    vectors[100:140] = vectors[0]
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(vectors)] + [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 20, 1), (1150, [float("inf")] * 20, 1), (1200, [1.0, 2.0], 1), (1203, [2.0, 2.0], 1), (1250, [], 1), (50, [float(x) for x in vectors[50]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df.select("vec_id", "embedding"), "vec_id % 50 = 0").collect())
    held = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (i, q) in enumerate(held):
        if i % 50 == 0:
            best = sorted((-int(q @ c), j) for b, (j, c) in enumerate(held) if b != a and len(c) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert exact_topk.top_k(df.select("vec_id", "embedding").limit(0), "vec_id % 50 = 0").count() == 0


def test_exact_topk_of_large_numbers(spark):
    rng = np.random.default_rng(7)
    vectors = np.floor(rng.normal(size=(120, 12)) * 2.0**26) / 256
    vectors[60:] = vectors[:60] + rng.integers(-1, 2, (60, 12)) / 256
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df, "vec_id % 50 = 0").collect())
    held = [[int(x) for x in np.floor(256 * v)] for v in vectors]
    want = []
    for i in range(0, 120, 50):
        best = sorted((-sum(a * b for a, b in zip(held[i], c)), j) for j, c in enumerate(held) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want and max(s for *_, s in got) > 2**52


def plain_components(rows, width, percent=80):
    def shingles(text):
        w = text.encode().lower().split()
        return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    names = collections.defaultdict(list)
    for a, (doc_id, _) in enumerate(rows):
        names[find(a)].append(doc_id)
    return collections.Counter((doc_id, len(sets[a]), min((x for x in names[find(a)] if x is not None), default=None)) for a, (doc_id, _) in enumerate(rows))


def near_family(spark):
    """A hub with many near copies that are often not near each other, and a chain."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = list(base)
        for j in rng.choice(120, 6, replace=False):
            words[j] = f"n{k}_{j}"
        rows.append((k, " ".join(words)))
    for k in range(20):
        words = [f"c{j}" for j in range(5 * k, 5 * k + 100)]
        rows.append((100 + k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which, width", [("odd", 2), ("docs", 5), ("family", 2)])
def test_near_duplicates(spark, request, which, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)
    df = near_family(spark) if which == "family" else request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width).collect())
    assert got == plain_components(pairs(df), width)


def test_components_of_long_chains(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = {r.node: r.component for r in near_dedup.components(edges).collect()}
    assert found == {k: 0 for k in range(1, 41)}
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_chat_roles(spark, sf):
    # the smallest tables have too few turns to learn from and too few of the other names
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/conversations.parquet").where("conv_id is not null")
    raw = chat_format.transcripts(table)
    model = chat_format.Model(chat_format.count_model(raw.where("conv_id % 2 = 0")))
    turns = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.render(chat_format.parse(raw.where("conv_id % 2 = 1").drop("state"), model)).collect()}
    truth = {(r.conv_id, r.turn * chat_format.TURN): (r.role, r.text.strip()) for r in table.where("conv_id % 2 = 1").collect()}
    named = {(r.conv_id, r.line) for r in raw.where("text rlike '^(Setup|Client|Helper): '").collect()} & set(truth)
    assert sum(turns.get(k) == v for k, v in truth.items() if k not in named) >= 0.95 * len(truth.keys() - named)
    # names that the model knows nothing of
    assert len(named) > 20 and sum(turns.get(k, ("",))[0] == truth[k][0] for k in named) >= 0.9 * len(named)
    assert chat_format.parse(raw.drop("state").limit(0), model).count() == 0


def plain_viterbi(rows, model):
    """(line, text, role, turn) of one conversation's rows by the best of all paths, worked out line by line."""
    rows = sorted(rows)
    sizes = [min(5, int(math.log2(len(t) + 1) / 2)) for _, t in rows]

    def emitted(i):
        text = rows[i][1]
        marker = 4 if re.match(chat_format.NAMED, text) else 0
        for k, role in enumerate(chat_format.ROLES, 1):
            marker = k if re.match(chat_format.marker_pattern(role), text) else marker
        last = 1 if re.search(r"\?\s*$", text) else 2 if re.search(r"[.!]\s*$", text) else 3 if re.search(r":\s*$", text) else 0
        seen = (marker, sizes[i], last, int(i > 0 and sizes[i - 1] == 0), int(i == 0))
        return [sum(t[s, v] for t, v in zip(model.tables, seen)) for s in range(len(chat_format.STATES))]

    best = [[(model.start[s] + e, [s]) for s, e in enumerate(emitted(0))]]
    for i in range(1, len(rows)):
        e = emitted(i)
        best.append([max((best[-1][a][0] + model.next[a, s] + e[s], best[-1][a][1] + [s]) for a in range(len(e))) for s in range(len(e))])
    states, turn, out = max(best[-1])[1], None, []
    for (line, text), s in zip(rows, states):
        turn = line if chat_format.STATES[s][1] else turn
        out.append((line, text, chat_format.STATES[s][0], turn))
    return out


def test_chat_paths_are_the_best_of_all(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id is not null")
    raw = chat_format.transcripts(table)
    model = chat_format.Model(chat_format.count_model(raw))
    big = (1 << 53) + 1
    odd = [(big, 0, "User: a large id"), (big, 4, "reply."), (None, 0, None), (None, 5, "User: hi"), (None, 5, "User: hi"), (7000, 0, "Note: x"), (7000, 0, "AI: x"), (7000, 3, ""), (7000, 4, "well?")]
    lines = raw.where("conv_id < 12").drop("state").unionByName(spark.createDataFrame(odd, "conv_id long, line long, text string"))
    extra = lines.withColumns({"state": F.lit("x"), "role": F.lit("y"), "turn": F.lit(-1), "span": F.lit(0), "task": F.lit(0)})
    for given in (lines, extra):
        held = collections.defaultdict(list)
        for r in lines.collect():
            held[r.conv_id].append((r.line, r.text or ""))
        want = collections.Counter((conv, *x) for conv, rows in held.items() for x in plain_viterbi(rows, model))
        assert collections.Counter(map(tuple, chat_format.parse(given, model).select("conv_id", "line", "text", "role", "turn").collect())) == want


def test_long_conversations_are_read_in_spans_with_the_same_result(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id is not null")
    raw = chat_format.transcripts(table)
    model = chat_format.Model(chat_format.count_model(raw))
    lines = raw.drop("state")
    lines = lines.unionByName(spark.createDataFrame([(None, 0, None), (None, 5, "User: hi"), (9999, 3 * chat_format.TURN, "AI: mid")], "conv_id long, line long, text string"))
    whole = sorted(map(str, chat_format.parse(lines, model).collect()))
    monkeypatch.setattr(chat_format, "SPAN", chat_format.TURN)
    parts = sorted(map(str, chat_format.parse(lines.where("conv_id <> 9999 or conv_id is null"), model).collect()))
    assert parts == [r for r in whole if "9999" not in r]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site, name, here</h1></header>
<nav><ul><li><a href=/a>Home page link</a></li><li><a href=/b>Other, link</a></li></ul></nav><div id="cookie-notice">We use cookies, really, on this site, accept them.</div>
<div class=wrap><div class="content"><h2>Fish &amp; chips</h2><p>First <b>bold</b> paragraph, with commas, and   some\n white&nbsp;space.<p>Second paragraph never closed, but long enough, surely.
<ul><li>One item</li><li>Two <a href=x>items</a></li></ul><div class="share">Share this, please, now</div><table><tr><td>cell</td><td>next</td></tr></table></div>
<aside>Related, things, to read, on the side.</aside><div class="comments"><p>Reader says, something long, with many, many, commas, here, today.</p></div></div>
<form>Your name, mail, text <input></form><footer>&copy; someone, somewhere</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Fish & chips\n\nFirst bold paragraph, with commas, and some white space.\n\nSecond paragraph never closed, but long enough, surely.\n\nOne item\n\nTwo items\n\ncell next"
    assert html_text.main_text("<html><body><article><h1>Head</h1><p>Short.</p></article><div class=ad>Buy, buy, buy, now, it, is, cheap.</div>") == "Head\n\nShort."
    assert html_text.main_text("plain   text &lt;only&gt;") == "plain text <only>"
    for page in (None, "", "<", "<p", "<script>x", "<!-- open", "</p></p>", "<a><b></a></b>" * 50, "<div>" * 3000 + "deep" + "</div>" * 10):
        html_text.main_text(page)


def test_html_extract(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.extract(pages.withColumn("text", F.lit("clash")))
    rows = got.collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert not any("©" in r.text for r in rows) and sum(bool(r.text) for r in rows) == len(rows)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_output(request, which):
    df = request.getfixturevalue(which)
    stored = token_output.write_tokens(df, P.path("byte_bpe_50k.json"))
    got = token_output.ids_crc32(token_output.with_starts(stored), "doc_id long, start long, n_tokens long").orderBy("start").collect()
    encode, at = tokenizer("byte_bpe_50k.json"), 0
    want = collections.Counter((i, len(encode(t)) + 1, crc(encode(t) + [0])) for i, t in pairs(df))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_token_files_answer_selective_reads(docs):
    stored = token_output.write_tokens(docs, P.path("byte_bpe_50k.json"))
    few = token_output.read_tokens(stored, 10, 12)
    assert sorted(r.doc_id for r in few.select("doc_id").collect()) == [10, 11]
    assert "GreaterThanOrEqual(doc_id,10)" in few._jdf.queryExecution().toString()
    counts = stored.groupBy("part").agg(F.sum("n_tokens"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<part:int,n_tokens:bigint>" in counts


@pytest.mark.parametrize("work", [
    packing.packed_digest, lm_score.score, lambda d: byte_bpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), secrets.scan, secrets.redact, lambda d: near_dedup.near_duplicates(d, 2),
    lambda d: token_output.with_starts(token_output.write_tokens(d, P.path("byte_bpe_50k.json"))), lambda d: quality.rate(d, d.select("doc_id", F.lit(1).alias("quality"))),
])
def test_empty_tables(odd, work):
    assert work(odd.limit(0)).count() == 0
