"""Secret scans through trigram postings, in DataFrame operations alone.

From each rule's regular expression a Boolean trigram query is derived: alternatives, each
with the trigrams that a match must hold. One pass over a text finds which of all queries' trigrams it holds: the document's postings.
They are intersected with the queries where the document lies, so that no text moves, and only candidates are verified with
the expression itself; rules without mandatory trigrams scan every text. ``postings`` gives the same lists as an inverted index (trigram, document)
to keep, and ``candidates`` intersects the lists of such an index for any rules whose trigrams it has.

Places of matches are running sums of the lengths of gaps and matches, worked out over pieces of an array whose length is
its square root; texts are cut out of pieces of ``PIECE`` characters. So a text of very many spans takes time with little more than its length.

Defined results: a null or empty text has no spans; repeated rows each get their spans; an
empty table gives an empty one; columns of the input other than ``doc_id`` and ``text`` are
kept as they are, whatever their names. Texts of any length are taken whole; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.shared import documents, let

#: Strings that a part of an expression may stand for, while they are still listed.
MOST_STRINGS = 64
#: Characters of a piece of text.
PIECE = 4096


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length decides, and the least length that it needs.
    group: int = 0
    least: int = 1
    #: An expression that tells sooner whether a text has a match that is long enough.
    probe: str | None = None


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: A query: alternatives, each a set of trigrams that must all be there. One without trigrams lets all texts pass.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    found = frozenset(x | y for x in a for y in b)
    return found if len(found) <= MOST_STRINGS else a


def _of_strings(strings: set[str]) -> Query:
    found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return ANY if frozenset() in found else found


def _derive(items) -> tuple[set[str] | None, Query]:
    """The strings a sequence may stand for, if they are few, and its query."""
    strings: set[str] = {""}
    whole, query = True, ANY

    def cut() -> None:
        nonlocal strings, whole, query
        query, strings, whole = _both(query, _of_strings(strings)), {""}, False

    def extend(by: set[str]) -> None:
        nonlocal strings
        if len(strings) * len(by) > MOST_STRINGS:
            cut()
        strings = {a + b for a in strings for b in by} if len(by) <= MOST_STRINGS else {""}

    for op, value in items:
        if op is sre.LITERAL:
            extend({chr(value).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 8:
            extend({chr(v).lower() for _, v in value})
        elif op is sre.SUBPATTERN:
            inner, q = _derive(value[3])
            if inner is None:
                cut()
                query = _both(query, q)
            else:
                extend(inner)
        elif op is sre.BRANCH:
            parts = [_derive(x) for x in value[1]]
            if all(p is not None for p, _ in parts):
                extend(set().union(*(p for p, _ in parts)))
            else:
                cut()
                query = _both(query, frozenset().union(*(_of_strings(p) if p is not None else q for p, q in parts)))
        elif op is sre.MAX_REPEAT:
            low, high, inner = value
            sub, q = _derive(inner)
            if (low, high) == (0, 1) and sub is not None:
                extend(sub | {""})
            elif low and sub is not None and len(sub) <= 8:
                extend(sub)
                cut()
            else:
                cut()
                if low:
                    query = _both(query, q)
        else:
            cut()
    if whole:
        return strings, _of_strings(strings)
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, of which each match holds one alternative whole."""
    _, query = _derive(parser.parse(pattern))
    # an alternative that holds another is met whenever that is
    return frozenset(a for a in query if not any(b < a for b in query))


def any_of(trigrams: list[str]) -> str:
    """An expression that captures, wherever one begins, one of the trigrams; they share first and second characters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(trigrams):
        tree.setdefault(a, {}).setdefault(b, []).append(c)

    def one(chars: list[str]) -> str:
        return re.escape(chars[0]) if len(chars) == 1 else f"[{''.join(map(re.escape, chars))}]"

    firsts = "|".join(f"{re.escape(a)}(?:{'|'.join(re.escape(b) + one(c) for b, c in more.items())})" for a, more in tree.items())
    return f"(?={one(sorted(tree))})(?=({firsts}))"


def held_trigrams(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Which of the trigrams that the rules' queries ask for are in a text, in one pass."""
    asked = sorted({t for rule in rules for one in trigram_query(rule.pattern) for t in one})
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(any_of(asked)), F.lit(1))) if asked else F.array().cast("array<string>")


def met(held: Column, rule: Rule) -> Column:
    """Whether some alternative of the rule's query is held whole."""
    out = F.lit(False)
    for one in sorted(map(sorted, trigram_query(rule.pattern))):
        out = out | (F.size(F.array_except(F.array(*map(F.lit, one)), held)) == 0)
    return out


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id, text_hash): the inverted index of the rules' trigrams, to be kept."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.explode(held_trigrams(text, rules)).alias("trigram"), "doc_id", F.xxhash64(text).alias("text_hash"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_hash, rules): the kinds whose trigram query a document meets, by intersecting posting lists."""
    asked = [(rule.kind, k, t, len(one)) for rule in rules for k, one in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))) for t in one]
    names = ("kind", "alternative", "trigram", "needed")
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in asked))))
    met = index.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "text_hash", "kind", "alternative").agg(F.size(F.collect_set("trigram")).alias("met"), F.max("needed").alias("needed"))
    return met.where("met = needed").groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("rules"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's whole numbers, what ``combine`` (a sum or a maximum, from 0) makes of those before it."""

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda held, x: F.concat(held, F.array(combine(F.element_at(held, -1), x))))

    def of(values: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(values))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / step).cast("int") - 1), lambda k: sums(F.slice(values, k * step + 1, step)))

        def joined(parts: Column) -> Column:
            before = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
            return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: combine(x, b))))

        return F.when(F.size(values) > 0, let(parts, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Leftmost non-overlapping matches as structs of start, place of the rule, kind and end, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # the last gap has no match
    sizes = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"), told.alias("told")),
        lambda r: F.struct(F.length(r["gap"]).alias("gap"), F.coalesce(F.length(r["match"]), F.lit(0)).alias("match"), F.coalesce(F.length(r["told"]), F.lit(-1)).alias("told")),
    )

    def placed(sizes: Column) -> Column:
        before = running(F.transform(sizes, lambda r: r["gap"] + r["match"]), lambda a, b: a + b)
        rows = F.zip_with(sizes, before, lambda r, b: F.struct((b + r["gap"]).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (b + r["gap"] + r["match"]).alias("end"), r["told"].alias("told")))
        kept = F.filter(rows, lambda r: r["told"] >= rule.least)
        return F.transform(kept, lambda r: F.struct(*(r[n].alias(n) for n in ("start", "place", "kind", "end"))))

    return let(sizes, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: structs of start, place, kind and end of every rule's matches, in order."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ANY)
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), text.alias("text"), held_trigrams(text, indexed).alias("held"))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    parts = []
    for place, rule in enumerate(rules):
        there = F.col("text").rlike(rule.probe or rule.pattern)
        wanted = met(F.col("held"), rule) & there if rule in indexed else there
        parts.append(F.when(wanted, spans_of(F.col("text"), rule, place)).otherwise(none))
    spans = F.array_sort(F.concat(*parts))
    return keyed.select("row.*", spans.alias("secret_spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans by one."""
    found = scan(docs, rules)

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """Characters from ``start`` up to ``end``, of the text's pieces."""

        def part(k: Column) -> Column:
            first = F.greatest(start - k * PIECE, F.lit(0))
            return F.substring(F.get(pieces, k), first + 1, F.least(end - k * PIECE, F.lit(PIECE)) - first)

        return F.when(end > start, F.array_join(F.transform(F.sequence((start / PIECE).cast("int"), ((end - 1) / PIECE).cast("int")), part), "")).otherwise("")

    def marked(pieces: Column) -> Column:
        spans = F.col("secret_spans")
        rows = F.zip_with(spans, running(F.transform(spans, lambda x: x["end"]), F.greatest), lambda x, b: F.struct(x["start"].alias("start"), b.alias("before")))
        # a span that begins inside an earlier one has the earlier one's mark
        opened = F.transform(F.filter(rows, lambda r: r["start"] >= r["before"]), lambda r: F.concat(cut(pieces, r["before"], r["start"]), F.lit(mark)))
        return F.concat(F.array_join(opened, ""), cut(pieces, F.array_max(F.transform(spans, lambda x: x["end"])), F.length("text")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return found.withColumn("text", F.when(F.size("secret_spans") > 0, let(pieces, marked)).otherwise(F.col("text"))).drop("secret_spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))


def _rule_sql(place: int, rule: Rule) -> str:
    """The rule's spans: gaps and matches before a match add up to its start."""
    # a run without a group is long enough or not as a whole, so its least length can stand in the expression
    pattern = (f"{rule.probe[:-1]},}}" if rule.probe else rule.pattern).replace("'", "''")
    return f"""SELECT at_row, {place} AS place, '{rule.kind}' AS kind, begins, begins + length(m[i]) AS ends FROM (
  SELECT *, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS begins FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT at_row, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS told, string_split_regex(text, '{pattern}') AS gap FROM t WHERE regexp_matches(text, '{pattern}'))))
  WHERE length(told[i]) >= {rule.least}"""


def _listed(where: str) -> str:
    return f"SELECT at_row, string_agg(kind || ':' || CAST(begins AS VARCHAR) || ':' || CAST(ends AS VARCHAR), ',' ORDER BY begins, place) AS listed FROM s WHERE {where} GROUP BY at_row"


ORACLE = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS at_row, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED (SELECT at_row, place, kind, CAST(begins AS BIGINT) AS begins, CAST(ends AS BIGINT) AS ends FROM ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(RULES))})),
n AS (SELECT at_row, {', '.join(f"count(CASE WHEN kind = '{r.kind}' THEN 1 END) AS n_{r.kind}" for r in BASE)} FROM s GROUP BY at_row),
b AS ({_listed(f"place < {len(BASE)}")}), a AS ({_listed("true")})
SELECT t.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans
FROM t LEFT JOIN n ON t.at_row = n.at_row LEFT JOIN b ON t.at_row = b.at_row LEFT JOIN a ON t.at_row = a.at_row"""
