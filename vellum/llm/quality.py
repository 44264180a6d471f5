"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Node scores are linear in the line's features and in those of
the lines before and after it, edge scores in the pair of states. Forward-backward gives
every line's marginal of being good; their mean, weighted by line length, is mapped to a
score by a logistic curve fitted on the same sample. Features are counts over UTF-8 bytes
and so do not depend on a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, table, text_bytes, text_steps, tidy

#: The sample on which the model is fitted: labelled documents, and lines of each.
TRAIN_DOCS, TRAIN_LINES = 4000, 300
ROUNDS, RATE, RIDGE = 160, 0.08, 1e-3


def _luts() -> list[np.ndarray]:
    """Nine byte classes, three to a table, each in a 21-bit field of the entry."""
    groups = [
        set(range(65, 91)),
        set(range(97, 123)),
        set(range(48, 58)),
        set(b" \t\r\x0b\x0c"),
        set(range(128, 192)),  # continuation bytes
        set(range(192, 256)),  # first bytes of other letters
        set(b".,;:?'\"()-"),
        set(b"!"),
        set(b"#$%&*+/<=>@[\\]^_`{|}~"),
    ]
    out = []
    for at in (0, 3, 6):
        lut = np.zeros(256, np.uint64)
        for k in range(3):
            for b in groups[at + k]:
                lut[b] += np.uint64(1 << 21 * k)
        out.append(lut)
    return out


LUTS = _luts()
MARKS = np.zeros(256, bool)
MARKS[[*b"!#$%&*+/<=>@[\\]^_`{|}~.,;:?-"]] = True
#: A longer run without a line break counts as several lines of this length.
LONGEST = 1 << 20
FEATURES = 17


def line_features(data: memoryview, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document number, length in bytes and features of every line that is not empty."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    breaks = np.flatnonzero(b == 10)
    starts = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    starts = starts[starts < len(b)]
    size = np.diff(np.append(starts, len(b)))
    if (size > LONGEST).any():  # cut from the line's own start
        starts = np.concatenate([np.arange(s, s + n, LONGEST) for s, n in zip(starts.tolist(), size.tolist(), strict=True)])
    ends = np.append(starts[1:], len(b))
    size = ends - starts
    last = b[ends - 1] == 10
    full = size - last
    counts = []
    for lut in LUTS:
        sums = np.add.reduceat(lut[b], starts)
        counts += [((sums >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1)).astype(np.float32) for k in range(3)]
    upper, lower, digit, space, _, other, stop, bang, odd = counts
    twice = np.zeros(len(b), np.uint8)
    np.logical_and(b[1:] == b[:-1], MARKS[b[1:]], out=twice[1:].view(bool))
    twice[starts] = 0  # what stands before a line, or before the text, is not the line's
    runs = np.add.reduceat(twice, starts, dtype=np.int64).astype(np.float32)
    n = np.maximum(full, 1).astype(np.float32)
    letters = np.maximum(upper + lower + other, 1)
    words = space + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    seen: set = set()
    again = np.zeros(len(starts), np.float32)
    same, kinds = np.zeros(len(starts), np.float32), np.zeros(len(starts), np.float32)
    at = -1
    for i, (d, s, e) in enumerate(zip(doc.tolist(), starts.tolist(), (starts + full).tolist(), strict=True)):
        if d != at:
            at = d
            seen = set()
        line = bytes(data[s:e])
        if line in seen:
            again[i] = 1
        else:
            seen.add(line)
        run = line.split()
        if len(run) > 1:
            same[i] = sum(map(eq, run, islice(run, 1, None))) / len(run)
            kinds[i] = 1 - len(set(run)) / len(run)
    close = b[np.maximum(starts + full - 1, 0)]
    x = np.stack(
        [
            np.log1p(n) / 5, upper / letters, digit / n, space / n, other / n, stop / n, bang / n, odd / n, runs / n,
            np.minimum((upper + lower + other) / words, 20) / 10, again, np.isin(close, [*b".!?"]).astype(np.float32),
            (odd > 0.3 * words).astype(np.float32), (upper > 0.6 * letters).astype(np.float32), same, (same > 0.3).astype(np.float32), kinds,
        ], axis=1,
    ).astype(np.float32)
    keep = full > 0
    return doc[keep], full[keep], x[keep]


def _with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    same = np.zeros((len(doc), 1), np.float32)
    same[1:, 0] = doc[1:] == doc[:-1]
    up, down = np.zeros_like(x), np.zeros_like(x)
    up[1:], down[:-1] = x[:-1] * same[1:], x[1:] * same[1:]
    below = np.append(same[1:], np.zeros((1, 1), np.float32), axis=0) if len(doc) else same
    return np.concatenate((x, up, down, same, below), axis=1)


@dataclass
class Chains:
    """Lines of several documents, in the order in which the recursions go through them:
    step t holds line t of every document that has one."""

    steps: list[np.ndarray]

    @staticmethod
    def of(doc: np.ndarray) -> Chains:
        if not len(doc):
            return Chains([])
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, len(doc)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        return Chains([first[: np.searchsorted(-size, -t)] + t for t in range(int(size[0]))])


def forward_backward(node: np.ndarray, edge: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the good state, summed pair marginals (2 x 2), log partition sum.
    node: score of good against bad per line; edge[a, b]: score of state b after state a."""
    n = len(node)
    scores = np.zeros((n, 2))
    scores[:, 1] = node
    alpha, beta = scores.copy(), np.zeros((n, 2))
    for t in range(1, len(chains.steps)):
        at = chains.steps[t]
        come = alpha[at - 1][:, :, None] + edge
        alpha[at] += np.logaddexp(come[:, 0], come[:, 1])
    for t in range(len(chains.steps) - 2, -1, -1):
        at = chains.steps[t + 1]
        go = edge + (scores[at] + beta[at])[:, None, :]
        beta[at - 1] = np.logaddexp(go[:, :, 0], go[:, :, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    if len(chains.steps) > 1:
        at = np.concatenate(chains.steps[1:])
        p = alpha[at - 1][:, :, None] + edge + (scores[at] + beta[at])[:, None, :] - total[at][:, None, None]
        pairs = np.exp(p).sum(axis=0)
    log_z = float(total[chains.steps[0]].sum()) if chains.steps else 0.0
    return np.exp(both[:, 1] - total), pairs, log_z


@dataclass
class Crf:
    """weights: one for each feature, then the bias; edge: 2 x 2; slope, shift: score curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edge: np.ndarray
    slope: float = 4.0
    shift: float = -2.0

    def marginals(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = (_with_neighbours(doc, x) - self.mean) / self.scale
        # a sum for each line by itself: the same whatever lines stand beside it
        return forward_backward((z * self.weights[:-1]).sum(axis=1) + self.weights[-1], self.edge, Chains.of(doc))[0]

    def quality(self, n: int, doc: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The length-weighted mean marginal of each of n documents; 0 for those without lines."""
        good = np.bincount(doc, self.marginals(doc, x) * size, n)
        return good / np.maximum(np.bincount(doc, size, n), 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * quality + self.shift)))


def fit(doc: np.ndarray, size: np.ndarray, x: np.ndarray, label: np.ndarray) -> Crf:
    """Fits the field to documents' labels, then the score curve to the documents' means.
    doc numbers the documents from 0; label has one 0 or 1 for each. Lines start with
    their document's label; in documents labelled bad, lines that the first model takes
    for good are relabelled before the second fit."""
    wide = _with_neighbours(doc, x).astype(np.float64)
    model = Crf(wide.mean(axis=0), wide.std(axis=0) + 1e-3, np.zeros(wide.shape[1] + 1), np.zeros((2, 2)))
    z, chains = (wide - model.mean) / model.scale, Chains.of(doc)
    inner = np.concatenate(chains.steps[1:]) if len(chains.steps) > 1 else np.zeros(0, int)
    y = label[doc].astype(float)
    for turn in range(2):
        if turn:
            good = model.marginals(doc, x)
            y = np.where((label[doc] == 0) & (good > 0.9), 1.0, label[doc])
            lost = np.bincount(doc, 1 - y, len(label)) == 0
            y = np.where(lost[doc], label[doc], y)
        want = np.zeros((2, 2))
        np.add.at(want, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        theta = np.concatenate((model.weights, model.edge.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, ROUNDS + 1):
            w, edge = theta[:-4], theta[-4:].reshape(2, 2)
            p, pairs, _ = forward_backward(z @ w[:-1] + w[-1], edge, chains)
            d = p - y
            grad = np.concatenate((z.T @ d, [d.sum()], (pairs - want).ravel())) / len(y) + RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights, model.edge = theta[:-4], theta[-4:].reshape(2, 2)
    q = model.quality(len(label), doc, size, x)
    a, b = 4.0, -2.0
    for _ in range(400):  # Newton steps, damped
        p = 1 / (1 + np.exp(-(a * q + b)))
        r, h = p - label, p * (1 - p) + 1e-6
        g = np.array([(r * q).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        hess = np.array([[(h * q * q).sum() + 1e-3, (h * q).sum()], [(h * q).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        a, b = a - 0.5 * move[0], b - 0.5 * move[1]
        if np.abs(move).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, mod: int = 3) -> Crf | None:
    """A model fitted on the labelled documents whose crc32(doc_id) mod `mod` is not 1: the
    train_docs ids of least hash, with their first train_lines lines. Several labels of an
    id count as the least, and of several texts of an id the one of least hash is read; ids and
    labels that are null, and labels other than 0 and 1, are ignored. None if there is nothing
    to learn from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), mod))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            doc, size, x = line_features(*text_bytes(batch))
            rows = []
            for d in range(batch.num_rows):
                lo, hi = np.searchsorted(doc, [d, d + 1])
                hi = min(hi, lo + train_lines)
                rows.append((size[lo:hi].astype(np.int64).tobytes(), x[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "quality", "size", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    met = src.join(F.broadcast(known.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id")
    least = met.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("th"))  # a row for each id of the sample
    met = met.join(F.broadcast(least), "doc_id").filter(F.xxhash64("text") == F.col("th"))
    got = met.select("doc_id", "quality", "text").mapInArrow(tidy(run), f"doc_id {kind}, quality int, size binary, x binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("quality", "size", "x")).alias("of")).select("doc_id", "of.*").collect()
    got = sorted((r for r in got if r["size"]), key=lambda r: r["doc_id"])
    label = np.array([r["quality"] for r in got])
    if not len(label) or label.min() == label.max():
        return None
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in got])
    x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in got]).reshape(len(size), -1)
    doc = np.repeat(np.arange(len(got)), [len(r["size"]) // 8 for r in got])
    return fit(doc, size, x, label)


def score(docs: DataFrame, model: Crf | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `score` (0 to 1): one row per input row, no shuffle.

    Null and empty texts have the score of a text without a good line. Whole texts are
    read, however long. Without a model every score is 0.5. Columns that are not kept are
    ignored and cannot clash.
    """
    src = docs.select(*[c for c in keep if c != "text"], F.col("text").cast("string").alias("__text"), *(["text"] if "text" in keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "__text"):
            if model is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                out = model.score(model.quality(batch.num_rows, *line_features(*text_bytes(batch, "__text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(tidy(run), f"{fields}, score double")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of `documents`: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
