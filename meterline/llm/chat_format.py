"""Chat formatting: roles of raw transcripts by a hidden Markov model, and canonical turns.

A transcript is lines (conv_id, line, text) with increasing line numbers. A line's hidden
state is a role and whether it begins a turn; what is seen are its speaker marker (of a role, or some other name), length, last character and blank lines before. The
model's tables are counted from labelled lines. Viterbi runs over spans of ``SPAN`` line
numbers: each span gives its best score from every state to every state, a conversation's
spans are chained, and each span then finds its path between the states chosen for its
edges. So the longest conversation is split over tasks like any other; a single turn's lines stay in one span.

Defined results: null text is an empty line; a transcript without markers is read by its
other features; a speaker who is none of the three roles is read as the likeliest of them, and a name that no role goes by stays in the text; the first line always begins a turn; repeated lines of one number are all kept, in the order of their
text; lines without a number, as a null turn's, stand after all others of their conversation, as line ``LAST``; a null conv_id is a conversation of its own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.shared import arrow_schema, table, written

ROLES = ("system", "user", "assistant")
#: States: begin and continue of each role.
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Ways in which transcripts name a speaker at the start of a turn.
MARKERS = {"system": ("System", "Instructions", "SYSTEM"), "user": ("User", "Human", "Q", "Customer"), "assistant": ("Assistant", "AI", "A", "Bot")}
#: Names that transcripts also use and that the model is not told of.
OTHER_NAMES = {"system": "Setup", "user": "Client", "assistant": "Helper"}
#: A name before a colon at the start of a line.
NAMED = r"^\s*(?:#+\s*|\*\*|\[)?[A-Z][A-Za-z]{0,15}(?:\*\*|\])?\s*:\s"
#: Line numbers of a turn and of a span of turns; a turn may have as many lines as an int counts.
TURN, SPAN = 1 << 31, 1 << 40
#: The number of lines that come without one.
LAST = 1 << 62
#: Lines that one task works on, about.
TASK_LINES = 50_000
#: Spans that one task chains, about.
CHAIN_SPANS = 20_000
FEATURES = {"marker": 5, "size": 6, "last": 4, "gap": 2, "first": 2}


def marker_pattern(role: str) -> str:
    return rf"^\s*(?:#+\s*|\*\*|\[)?(?:{'|'.join(MARKERS[role])})(?:\*\*|\])?\s*(?::|>|-)\s*"


def seen(lines: DataFrame) -> DataFrame:
    """Adds what is observed of each line, a small integer for each of FEATURES but ``gap`` and ``first``, which need the line before."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marker = F.when(text.rlike(NAMED), 4).otherwise(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(text.rlike(marker_pattern(role)), k).otherwise(marker)
    size = F.least(F.lit(5), F.floor(F.log2(F.length(text) + 1) / 2)).cast("int")
    last = F.when(text.rlike(r"\?\s*$"), 1).when(text.rlike(r"[.!]\s*$"), 2).when(text.rlike(r":\s*$"), 3).otherwise(0)
    return lines.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("line").cast("long"), F.lit(LAST)).alias("line"), text.alias("text"), marker.alias("marker"), size.alias("size"), last.alias("last"), *[c for c in ("state",) if c in lines.columns])


def _dealt(lines: DataFrame) -> DataFrame:
    """Adds ``span`` and ``task``, the group in which a span is worked on."""
    n = max(1, -(-lines.count() // TASK_LINES))
    return lines.withColumn("span", F.floor(F.col("line") / SPAN)).withColumn("task", F.pmod(F.xxhash64("conv_id", "span"), F.lit(n)))


def _chains(dealt: DataFrame) -> int:
    """Groups in which conversations are chained from their spans: 64, or more if a group would get over ``CHAIN_SPANS``."""
    return max(64, -(-dealt.select("conv_id", "span").distinct().count() // CHAIN_SPANS))


def _runs(rows: pa.Table, columns: tuple[str, ...]):
    """The runs of equal values in sorted rows: the values, a null as None, and the rows."""
    if not rows.num_rows:
        return
    changed = np.zeros(rows.num_rows, bool)
    changed[0] = True
    for c in columns:
        missing, values = rows[c].is_null().to_numpy(), rows[c].fill_null(0).to_numpy()
        changed[1:] |= (missing[1:] != missing[:-1]) | (values[1:] != values[:-1])
    begins = np.flatnonzero(changed)
    for begin, n in zip(begins.tolist(), np.diff(np.append(begins, rows.num_rows)).tolist()):
        part = rows.slice(begin, n)
        yield tuple(part[c][0].as_py() for c in columns), part


def _spans(group: pa.Table):
    """Each span of a group: its key, its rows in order, and its features as an array."""
    rows = group.sort_by([(c, "ascending") for c in ("conv_id", "span", "line", "text")]).combine_chunks()
    for key, part in _runs(rows, ("conv_id", "span")):
        marker, size, last = (part[c].to_numpy() for c in ("marker", "size", "last"))
        gap = np.concatenate([[0], (size[:-1] == 0).astype(int)])
        first = np.zeros(len(size), int)
        first[0] = key[1] == 0
        yield key, part, np.column_stack([marker, size, last, gap, first]).astype(int)


def count_model(labelled: DataFrame) -> dict[tuple[str, int, int], int]:
    """Counts of states, transitions and features from lines with a known ``state``; a few hundred numbers."""
    ddl = "kind string, a int, b int, n long"
    schema = arrow_schema(ddl)

    def count(group: pa.Table) -> pa.Table:
        held: dict[tuple, int] = {}
        for key, part, features in _spans(group):
            states = part["state"].to_numpy()
            for a, b in zip(states, states[1:]):
                held["next", int(a), int(b)] = held.get(("next", int(a), int(b)), 0) + 1
            if key[1] == 0:
                held["start", 0, int(states[0])] = held.get(("start", 0, int(states[0])), 0) + 1
            for j, name in enumerate(FEATURES):
                for s, v in zip(states, features[:, j]):
                    held[name, int(s), int(v)] = held.get((name, int(s), int(v)), 0) + 1
        return pa.Table.from_arrays([pa.array([k[i] for k in held], schema.field(i).type) for i in range(3)] + [pa.array(list(held.values()), pa.int64())], schema=schema)

    counts = _dealt(seen(labelled)).groupBy("task").applyInArrow(count, ddl).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return {(r["kind"], r["a"], r["b"]): r["n"] for r in counts.collect()}


class Model:
    """Log probabilities of the hidden Markov model, smoothed by one half."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        n = len(STATES)

        def logs(kind: str, rows: int, columns: int) -> np.ndarray:
            m = np.array([[counts.get((kind, a, b), 0) + 0.5 for b in range(columns)] for a in range(rows)])
            return np.log(m / m.sum(axis=1, keepdims=True))

        self.next = logs("next", n, n)
        for a, (role, _) in enumerate(STATES):
            for b, (other, begins) in enumerate(STATES):
                if not begins and other != role:
                    self.next[a, b] = -np.inf  # a turn goes on in its own role
        self.start = np.where([begins for _, begins in STATES], logs("start", 1, n)[0], -np.inf)
        self.tables = [logs(name, n, size) for name, size in FEATURES.items()]

    def emitted(self, features: np.ndarray) -> np.ndarray:
        return sum(t[:, features[:, j]].T for j, t in enumerate(self.tables))

    def transfer(self, features: np.ndarray) -> np.ndarray:
        """Best log score from each state before the span to each state at its end."""
        e = self.emitted(features)
        m = self.next + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.next[None]).max(axis=1) + row
        return m

    def path(self, features: np.ndarray, before: int, end: int) -> list[int]:
        """The best states of a span between the state before it (-1: none) and its last."""
        e = self.emitted(features)
        at = (self.start if before < 0 else self.next[before]) + e[0]
        back = []
        for row in e[1:]:
            m = at[:, None] + self.next
            back.append(m.argmax(axis=0))
            at = m.max(axis=0) + row
        states = [end]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, line, text, role, and turn, the number of the line that begins the line's turn."""
    dealt = written(_dealt(seen(lines.drop("state"))), "lines")
    moves_ddl = "conv_id long, span long, scores array<double>"
    moves_schema = arrow_schema(moves_ddl)
    n = len(STATES)

    def moves(group: pa.Table) -> pa.Table:
        rows = []
        for key, _, features in _spans(group):
            scores = model.transfer(features) if key[1] else np.tile(model.start + model.emitted(features)[0], (n, 1))
            if not key[1] and len(features) > 1:
                scores = (scores[:, :, None] + model.transfer(features[1:])[None]).max(axis=1)
            rows.append((*key, scores.ravel()))
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(moves_schema)], schema=moves_schema)

    edges_ddl = "conv_id long, span long, before int, end int"
    edges_schema = arrow_schema(edges_ddl)

    def chain(group: pa.Table) -> pa.Table:
        rows = []
        ordered = group.sort_by([("conv_id", "ascending"), ("span", "ascending")]).combine_chunks()
        for (conv,), part in _runs(ordered, ("conv_id",)):
            at, back, spans = None, [], part["span"].to_pylist()
            for scores in part["scores"].to_pylist():
                m = np.asarray(scores).reshape(n, n)
                if at is None:
                    # without a first span, the conversation starts here
                    at, choice = (m[0], np.full(n, -1)) if spans[0] == 0 else ((model.start[:, None] + m).max(axis=0), np.full(n, -1))
                else:
                    both = at[:, None] + m
                    at, choice = both.max(axis=0), both.argmax(axis=0)
                back.append(choice)
            end = int(at.argmax())
            for k in range(len(spans) - 1, -1, -1):
                before = int(back[k][end])
                rows.append((conv, spans[k], before, end))
                end = before
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(edges_schema)], schema=edges_schema)

    named_ddl = "conv_id long, span long, line long, text string, role string, turn long"
    named_schema = arrow_schema(named_ddl)

    def name(key, group, told):
        edge = {(c, s): (b, e) for c, s, b, e in zip(*(told[c].to_pylist() for c in ("conv_id", "span", "before", "end")))}
        out = []
        for (conv, span), part, features in _spans(group):
            states = model.path(features, *edge[conv, span])
            turn = None
            for line, text, s in zip(part["line"].to_pylist(), part["text"].to_pylist(), states):
                turn = line if STATES[s][1] else turn
                out.append((conv, span, line, text, STATES[s][0], turn))
        return pa.Table.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(named_schema)], schema=named_schema)

    keys = F.pmod(F.xxhash64("conv_id"), F.lit(_chains(dealt)))
    edges = dealt.groupBy("task").applyInArrow(moves, moves_ddl).withColumn("key", keys).groupBy("key").applyInArrow(chain, edges_ddl)
    tasks = dealt.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.col("task").alias("at")).distinct()
    edges = edges.join(tasks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s"))).select(F.col("at").alias("task"), "conv_id", "span", "before", "end")
    named = written(dealt.groupBy("task").cogroup(edges.groupBy("task")).applyInArrow(name, named_ddl), "named")
    # a span may go on with a turn of an earlier one
    last = named.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    order = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.max("last").over(order).alias("earlier")).where("earlier is not null")
    open_lines = named.where("turn is null").join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")), "left")
    closed = open_lines.select("conv_id", "line", "text", "role", F.coalesce("earlier", "line").alias("turn"))
    return named.where("turn is not null").select("conv_id", "line", "text", "role", "turn").unionByName(closed)


def without_marker(text: Column, role: Column) -> Column:
    out = text
    for r in ROLES:
        out = F.when(role == r, F.regexp_replace(text, marker_pattern(r), "")).otherwise(out)
    return out


def render(parsed: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, role, text without markers and blank edges, and the canonical rendering."""
    text = F.when(F.col("line") == F.col("turn"), without_marker(F.col("text"), F.col("role"))).otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("line", text.alias("text"))))
    turns = parsed.groupBy("conv_id", "turn", "role").agg(lines.alias("lines"))
    body = F.regexp_replace(F.array_join(F.col("lines.text"), "\n"), r"\A\s+|\s+\z", "")
    return turns.select("conv_id", "turn", "role", body.alias("text")).withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcript lines of the table's turns, with ``state`` as label: speakers are named in one of several ways, a twentieth by a name that no role goes by,
    or not at all after a blank line, as a hash of the turn decides.
    """
    key = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(20)).cast("int")
    lead = F.lit("")
    for role, names in MARKERS.items():
        forms = F.array(*(F.lit(f.format(x)) for x in names for f in ("{}: ", "**{}**: ", "### {}: ", "[{}]: ")))
        lead = F.when((F.col("role") == role) & (key == 1), f"{OTHER_NAMES[role]}: ").when((F.col("role") == role) & (key % 5 > 0), F.get(forms, F.pmod(F.xxhash64("turn", "conv_id"), F.size(forms)).cast("int"))).otherwise(lead)
    body = F.concat(F.when(key % 5 == 0, "\n").otherwise(lead), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", "role", F.posexplode(F.split(body, "\n")).alias("k", "text"))
    state = F.lit(None).cast("int")
    for s, (role, begins) in enumerate(STATES):
        state = F.when((F.col("role") == role) & ((F.col("k") == 0) == F.lit(begins)), s).otherwise(state)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), (F.col("turn").cast("long") * TURN + F.col("k")).cast("long").alias("line"), "text", state.alias("state"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transcripts(table(spark, sf_dir, "conversations"))
    # roles of a fifth of the conversations teach the model
    model = Model(count_model(raw.where(F.col("state").isNotNull() & (F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0))))
    return render(parse(raw.drop("state"), model))
