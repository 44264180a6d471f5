"""Chat transcripts: roles by a hidden Markov model, then canonical rendering.

A transcript is a sequence of lines. The model's hidden state is a role and whether the
line opens a turn or continues one; it sees each line's speaker marker (or its absence),
length, ending and first letter. Emissions and transitions are counted on labelled
conversations. Viterbi's recursion runs over pieces of at most one partition: a piece is
summed up as a (max, +) matrix from the state before it to the state after it, the matrices
of a conversation are chained, and each piece is then decoded between its known ends. So a
conversation of any length is decoded exactly without meeting in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import held_out, parts, staged, table, tidy

ROLES = ("system", "user", "assistant")
#: States: role times (opens, continues).
N = 2 * len(ROLES)
#: Speaker markers by role, as transcripts write them. A parameter of the parser.
MARKERS = {
    "system": ("system", "instructions", "<|system|>", "### instruction"),
    "user": ("user", "human", "question", "q", "me", "<|user|>", "### human", "### user"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "<|assistant|>", "### assistant", "### response"),
}
_WORDS = {w: i for i, r in enumerate(ROLES) for w in MARKERS[r]}
_MARK = re.compile(r"^[\s>*\[(]*(<\|\w+\|>|###\s*\w+|[A-Za-z]{1,12})[\])*]*\s*(?::|>|-\s|(?<=\|>)|$)[*]*\s?", re.ASCII)
SIGNS = len(ROLES) + 1  # the marker's role, or none
LENGTHS, ENDS, FIRSTS = 6, 3, 3


def marker(line: str) -> tuple[int, str]:
    """The role that the line's speaker marker names (3: none), and the rest of the line."""
    m = _MARK.match(line)
    if m:
        word = re.sub(r"###\s*", "### ", m[1].lower())
        if word in _WORDS:
            return _WORDS[word], line[m.end() :]
    return len(ROLES), line


def features(line: str) -> tuple[int, int, int, int]:
    """sign, length class, ending, first letter"""
    sign, rest = marker(line)
    rest = rest.strip()
    size = min(LENGTHS - 1, len(rest).bit_length() // 2)
    end = 0 if rest.endswith("?") else 1 if rest.endswith((".", "!", ":")) else 2
    first = 2 if not rest else 0 if rest[0].isupper() else 1
    return sign, size, end, first


class Hmm:
    """log probabilities: start (N), step (N, N), and one table (N, values) for each feature."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        norm = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True))
        self.start, self.step, self.emit = norm(start), norm(step), [norm(e) for e in emit]
        for role in range(len(ROLES)):  # a role's own later lines follow its first; others open a turn
            for to in range(N):
                if to % 2 and to // 2 != role:
                    self.step[2 * role : 2 * role + 2, to] = -np.inf
        self.start[1::2] = -np.inf

    def emissions(self, lines: list[str]) -> np.ndarray:
        seen = np.array([features(x) for x in lines], np.int64).reshape(len(lines), 4)
        return sum(e[:, seen[:, f]].T for f, e in enumerate(self.emit))

    def summary(self, b: np.ndarray, first: bool) -> np.ndarray:
        """matrix[i, j]: best log probability of the lines from state i before them to state
        j at the last. For a conversation's first piece every row is the start."""
        m = np.tile(self.start + b[0], (N, 1)) if first else self.step + b[0]
        for row in b[1:]:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + row
        return m

    def decode(self, b: np.ndarray, before: int, last: int) -> np.ndarray:
        """The best states of a piece that follows state `before` (-1: nothing) and ends in `last`."""
        score = (self.start if before < 0 else self.step[before]) + b[0]
        back = np.zeros(b.shape, np.int64)
        for t in range(1, len(b)):
            come = score[:, None] + self.step
            back[t] = come.argmax(axis=0)
            score = come[back[t], np.arange(N)] + b[t]
        out = np.empty(len(b), np.int64)
        out[-1] = last
        for t in range(len(b) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def train(lines: DataFrame) -> Hmm:
    """Counts of a labelled sample: conv_id, turn, line_no, role, line. Rows with a null
    conv_id, turn or a role outside ROLES are ignored. Only counts reach the driver: N times
    the features' values, and N times N transitions between a conversation's turns."""
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    good = lines.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isin(*ROLES))
    good = good.select("conv_id", "turn", (2 * role + F.when(F.col("line_no") == 0, 0).otherwise(1)).cast("int").alias("state"), "line")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([features(x or "") for x in batch.column("line").to_pylist()], np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("state"), *(pa.array(f[:, i]) for i in range(4))], names=["state", "f0", "f1", "f2", "f3"])

    emit = [np.zeros((N, n)) for n in (SIGNS, LENGTHS, ENDS, FIRSTS)]
    for r in good.select("state", "line").mapInArrow(tidy(seen), "state int, f0 int, f1 int, f2 int, f3 int").groupBy("state", "f0", "f1", "f2", "f3").count().collect():
        for f in range(4):
            emit[f][r["state"], r[f + 1]] += r["count"]
    # within turns: a first or later line is followed by a later one or by another turn
    turns = good.groupBy("conv_id", "turn").agg(F.min(F.col("state")).alias("state"), F.count(F.lit(1)).alias("n"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("state").alias("to"))
    start, step = np.zeros(N), np.zeros((N, N))
    for r in turns.groupBy("state").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("more"), F.sum(F.when(F.col("n") > 2, F.col("n") - 2).otherwise(0)).alias("on"), F.sum((F.col("turn") == 0).cast("int")).alias("first")).collect():
        s = r["state"] - r["state"] % 2
        start[s] += r["first"]
        step[s, s + 1] += r["more"]
        step[s + 1, s + 1] += r["on"]
    for r in turns.join(after, ["conv_id", "turn"]).groupBy("state", "to", (F.col("n") > 1).alias("long")).count().collect():
        step[r["state"] - r["state"] % 2 + int(r["long"]), r["to"] - r["to"] % 2] += r["count"]
    return Hmm(start, step, emit)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """The rows of each (key, piece), gathered from batches sorted by them: at most PIECE lines."""
    key, rows = None, None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols, strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


#: Lines of a piece at most, as a power of two.
PIECE = 12


def parse(lines: DataFrame, model: Hmm, piece_bits: int = PIECE) -> DataFrame:
    """conv_id, turn_no, role, text, rendered: the turns that Viterbi finds in the lines of
    each transcript (conv_id, at: array of longs that orders a transcript's lines, line).

    A null line counts as empty. A null conv_id is a transcript like another. Lines that
    tie in `at` follow by their text, so reruns agree. Other columns are ignored. Markers are cut off the lines that
    open a turn. A transcript's turns are numbered from 0; rendered is
    `<|role|>\\n` + text + `<|end|>\\n`. Repeated lines stay. An empty table gives no rows.
    """
    spark = lines.sparkSession
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("key")
    src = staged(lines.select("conv_id", "at", F.coalesce("line", F.lit("")).alias("line")), "chat-lines")
    order = src.repartitionByRange(parts(spark), "conv_id", "at", "line").sortWithinPartitions("conv_id", "at", "line")
    # numbers that rise along each transcript; their upper bits cut it into pieces
    rows = staged(order.select("conv_id", key, F.monotonically_increasing_id().alias("no"), "line"), "chat-rows")
    rows = rows.withColumn("piece", F.shiftright("no", piece_bits))
    spans = staged(rows.groupBy("key").agg(F.min("piece").alias("first"), F.max("piece").alias("last")), "chat-spans")
    spans = spans.filter("first < last")
    dealt = lambda df: df.repartition(parts(spark), "key", "piece").sortWithinPartitions("key", "piece", "no")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, piece), got in _runs(batches):
            m = model.summary(model.emissions([r[3] for r in got]), piece == got[0][4])
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([piece]), pa.array([m.ravel().tolist()])], names=["key", "piece", "m"])

    long = rows.join(spans, "key").select("key", "piece", "no", "line", "first")
    sums = dealt(long).mapInArrow(tidy(summed), "key string, piece long, m array<double>")

    def chained(tab: pa.Table) -> pa.Table:
        order = np.argsort(tab.column("piece").to_numpy())
        ms = [np.array(tab.column("m")[int(i)].as_py()).reshape(N, N) for i in order]
        score, back = ms[0][0], []
        for m in ms[1:]:
            come = score[:, None] + m
            back.append(come.argmax(axis=0))
            score = come.max(axis=0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pa.table({"key": tab.column("key"), "piece": tab.column("piece").take(pa.array(order)), "before": pa.array([-1, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32())})

    ends = staged(sums.groupBy("key").applyInArrow(chained, "key string, piece long, before int, end int"), "chat-ends")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            cols = list(zip(*held, strict=True)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "piece", "no", "state", "opened", "line"])

        for (k, piece), got in _runs(batches):
            b = model.emissions([r[3] for r in got])
            before, end = got[0][4], got[0][5]
            if end is None:  # the whole transcript is one piece
                before = -1
                end = int(model.summary(b, True)[0].argmax())
            opened = 0
            for r, state in zip(got, model.decode(b, before, end).tolist(), strict=True):
                opened += state % 2 == 0
                held.append((k, piece, r[2], state, opened, marker(r[3])[1] if state % 2 == 0 else r[3]))
            if len(held) > 5000:
                yield out()
        if held:
            yield out()

    known = rows.join(ends, ["key", "piece"], "left").select("key", "piece", "no", "line", "before", "end")
    states = staged(dealt(known).mapInArrow(tidy(decoded), "key string, piece long, no long, state int, opened int, line string"), "chat-states")
    per = states.groupBy("key", "piece").agg(F.max("opened").alias("n"))
    per = per.select("key", "piece", (F.sum("n").over(Window.partitionBy("key").orderBy("piece")) - F.col("n")).alias("base"))
    turns = states.join(staged(per, "chat-bases"), ["key", "piece"])
    turns = turns.withColumn("turn_no", F.col("base") + F.col("opened") - 1)
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.shiftright("state", 1) + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    turns = turns.groupBy("key", "turn_no", role.alias("role")).agg(text.alias("text"))
    conv = F.when(F.col("key") != "n", F.expr("substring(key, 2)")).cast(kind)
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    return turns.select(conv.alias("conv_id"), "turn_no", "role", "text", rendered.alias("rendered"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as transcripts are found: conv_id, at, line,
    and the turn, role and line_no that stand behind it. Each conversation has one of four
    ways to mark speakers; a turn in twelve has no marker. A null text is one empty line, a null
    role an empty marker; turns that are null stand first, turns that tie follow by the hash of
    role and text. Repeated rows are turns of their own; other columns are ignored."""
    way = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    title = F.initcap(F.coalesce(F.col("role"), F.lit("")))
    human = F.when(F.col("role") == "user", "Human").otherwise(title)
    short = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise(title)
    mark = (
        F.when(way == 0, F.concat(title, F.lit(": ")))
        .when(way == 1, F.concat(F.lit("### "), human, F.lit(": ")))
        .when(way == 2, F.concat(short, F.lit(": ")))
        .otherwise(F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("")), F.lit("|>")))
    )
    bare = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(12)) == 0
    row = conversations.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("h"), F.when(bare, "").otherwise(mark).alias("mark"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    line = F.when(F.col("line_no") == 0, F.concat("mark", "line")).otherwise(F.col("line"))
    return row.select("conv_id", "turn", "role", "line_no", F.array(F.col("turn").cast("long"), F.col("h"), F.col("line_no").cast("long")).alias("at"), line.alias("line"))


def op10_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from transcripts of `conversations`, and the turns rendered: conv_id,
    turn_no, role, text, rendered. The model learns from conversations whose crc32(conv_id)
    mod 3 is not 1; roles are no input of the parser."""
    lines = transcripts(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    model = train(lines.filter(~held_out(F.col("conv_id"), 3)))
    return parse(lines.select("conv_id", "at", "line"), model)
