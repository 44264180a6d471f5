"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is kept as its quantised logarithm q = 1 + floor(log_b c): the pairs (n-gram, 1)
to (n-gram, q) are put into a Bloom filter, and a reader probes (n-gram, 1), (n-gram, 2), ...
until one is missing. Counts never come out too small by that, and too large with small
probability. The model smooths bigrams by unigrams, both as read from the filter:

    P(w | v) = (c(v w) + K P(w)) / (c(v) + K),    P(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

N-grams are named by 64-bit hashes and counted in segments of the hash range. A segment's
part of the filter is made where its counts meet. The filter and the exact unigram counts
are broadcast in portions of bounded size; a corpus whose model needs more than one portion
is read once for each, with the quantised counts found so far kept by token, so that the
result does not depend on the number of portions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytehash import U, Hasher, mixed
from ._common import held_out, parts, release, staged, table, text_steps, tidy

#: Base of the quantised logarithm, filter bits and hash functions for each entry.
BASE, BITS, PROBES = 1.5, 8, 4
#: Weight of the unigram model, in counts.
SMOOTH = 20.0
#: Bytes of filter and unigram counts that are broadcast at once, at least; see portion_of().
PORTION = 80 << 20
#: Bytes of text whose n-grams a segment holds, about.
SEGMENT_TEXT = 16 << 20
#: Distinct keys that a task gathers before it sends them on; bytes hashed at a time.
GATHER, STEP = 1 << 20, 1 << 19
#: Bytes of text that are scored or counted at a time.
READ = 2 << 20
END, START = U(0x6A09E667F3BCC908), U(0xBB67AE8584CAA73B)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
MOST_Q = 255


def _tokens(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's ending with END; the number of tokens of each."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    hashes, starts_all = [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + STEP)
        if end < len(data):  # cut at white space
            back = np.flatnonzero(SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = end
                while ahead < len(data) and not SPACE[data[ahead]]:
                    ahead += 1
                end = min(len(data), ahead + 1)
        part = data[at:end]
        gap = np.concatenate(([True], SPACE[part], [True]))
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.flatnonzero(~gap[:-1] & gap[1:])
        if len(starts):
            hashes.append(hasher.of(hasher.prefix(part), starts, ends))
            starts_all.append(starts + at)
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(starts_all) if hashes else np.zeros(0, np.int64)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, edges)
    return np.insert(words, upto[1:], END), np.diff(upto) + 1


def _pairs(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token, and the key of the pair."""
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[np.cumsum(counts) - counts] = START
    return prev, mixed(prev * U(0xD6E8FEB86659FD93) + (tokens ^ (tokens >> U(31))) * U(0xA0761D6478BD642F))


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> U(32)) * U(segments) >> U(32)).astype(np.int64)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys with their bytes apart by significance: the leading ones compress."""
    return keys.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if n is None else (np.add.reduceat(n, first) if len(first) else n)
    return keys[first], sums.astype(np.int64)


def _count(segments: int):
    """Texts to partial counts: segment, kind (0 tokens, 1 pairs), keys, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STEP + 1, 31, fold=True)
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush():
            cols: list[list] = [[], [], [], []]
            for kind in (0, 1):
                keys, n = _tally(np.concatenate(held[kind]))
                cut = np.searchsorted(_segment(keys, segments), np.arange(segments + 1))
                for s in range(segments):
                    lo, hi = cut[s], cut[s + 1]
                    if lo < hi:
                        for c, v in zip(cols, (s, kind, _planes(keys[lo:hi]), n[lo:hi].astype(np.uint32).tobytes()), strict=True):
                            c.append(v)
                held[kind] = []
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["segment", "kind", "keys", "n"])

        for batch in text_steps(batches, most=READ):
            tokens, counts = _tokens(hasher, [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            held[0].append(tokens)
            held[1].append(_pairs(tokens, counts)[1])
            size += len(tokens)
            if size >= GATHER:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def quantised(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9), MOST_Q).astype(np.int64)


def restored(base: float = BASE) -> np.ndarray:
    """The mean count behind each quantised one; entry 0 is 0."""
    out = np.zeros(MOST_Q + 1)
    for q in range(1, MOST_Q + 1):
        lo, hi = math.ceil(base ** (q - 1) - 1e-9), math.ceil(base**q - 1e-9) - 1
        out[q] = (lo + hi) / 2 if lo <= hi and q < 60 else base ** (q - 0.5)
    return out


def _spots(keys: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int, probe: int) -> np.ndarray:
    h = mixed(keys + np.asarray(level).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    h = (h & U(0xFFFFFFFF)) + U(probe) * ((h >> U(32)) | U(1))
    return ((h & U(0xFFFFFFFF)) * np.asarray(bits).astype(np.uint64)) >> U(32)


def _filters(bits_each: int, probes: int):
    """Partial counts of whole segments to a row for each: its filter and exact token counts."""

    def made(s: int, own: list[list[tuple[bytes, bytes]]]) -> pa.RecordBatch:
        both = []
        for got in own:
            keys = [_unplanes(k) for k, _ in got]
            n = [np.frombuffer(x, np.uint32).astype(np.int64) for _, x in got]
            both.append(_tally(np.concatenate(keys), np.concatenate(n)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        keys, q = np.concatenate([b[0] for b in both]), quantised(np.concatenate([b[1] for b in both]))
        m = max(64, -(-int(q.sum()) * bits_each // 64) * 64)
        if m > 1 << 32:  # positions have 32 bits; segments of SEGMENT_TEXT stay far below
            raise OverflowError("a segment's filter needs more than 2**32 bits")
        flags = np.zeros(m, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            deep = keys[q >= level]
            for p in range(probes):
                flags[_spots(deep, level, m, p)] = True
        tokens, n = both[0]
        row = (s, np.packbits(flags, bitorder="little").tobytes(), tokens.tobytes(), n.tobytes(), len(tokens), int(n.sum()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["segment", "filter", "tokens", "n", "v", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, [[], []]  # rows come sorted by segment: one is held at a time
        for batch in batches:
            for s, kind, keys, n in zip(*(batch.column(c).to_pylist() for c in ("segment", "kind", "keys", "n")), strict=True):
                if s != at and at is not None:
                    yield made(at, own)
                    own = [[], []]
                at = s
                own[kind].append((keys, n))
        if at is not None:
            yield made(at, own)

    return run


MODEL = "segment int, filter binary, tokens binary, n binary, v long, total long"


def build(docs: DataFrame, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """The model of all texts of docs (a column text): a row for each segment that is not empty.

    A null text counts as empty: its end token is learnt. Whole texts and repeated rows count.
    The number of segments follows from the bytes of all texts. No texts: a model without rows."""
    text = F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    segments = max(16, 4 * parts(docs.sparkSession), -(-size // SEGMENT_TEXT))
    # a task has its segments pass one at a time, but sorts all of them: some eight each
    tasks = max(4, parts(docs.sparkSession) // 2, segments // 8)
    counted = docs.select(text.alias("text")).mapInArrow(tidy(_count(segments)), "segment int, kind int, keys binary, n binary")
    dealt = counted.repartition(tasks, "segment").sortWithinPartitions("segment")
    made = dealt.mapInArrow(tidy(_filters(bits, probes)), MODEL)
    return staged(made.withColumn("segments", F.lit(segments)), "lm-model")


def portion_of(spark: SparkSession) -> int:
    """Bytes of a portion: a tenth of the executors' memory, which is what Spark sets apart for other
    processes, shared by an executor's tasks."""
    conf = spark.sparkContext.getConf()
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}
    said = conf.get("spark.executor.memory", "1g").lower().rstrip("b")
    memory = int(said[:-1]) << unit[said[-1]] if said[-1] in unit else int(said)
    return max(PORTION, memory // (10 * int(conf.get("spark.executor.cores", "2"))))


class Portion:
    """Some segments of a model, as a worker holds them."""

    @staticmethod
    def packed(segments: int, rows: list[tuple]) -> tuple[int, list[tuple[int, int]], bytes, bytes, bytes]:
        """What is broadcast: number of segments, (segment, filter bytes), and all filters,
        tokens and counts end to end, so that a worker reads them where they lie."""
        rows = sorted(rows)
        return segments, [(r[0], len(r[1])) for r in rows], *(b"".join([bytes(r[i]) for r in rows]) for i in (1, 2, 3))

    def __init__(self, segments: int, sizes: list[tuple[int, int]], filters: bytes, tokens: bytes, counts: bytes):
        self.segments = segments
        self.bits, self.base = np.zeros(segments, np.int64), np.zeros(segments, np.int64)
        at = 0
        for s, size in sizes:
            self.bits[s], self.base[s] = size * 8, at
            at += size
        self.filter = np.frombuffer(filters, np.uint8)
        self.tokens = np.frombuffer(tokens, np.uint64)
        self.n = np.frombuffer(counts, np.int64)

    def levels(self, keys: np.ndarray, probes: int) -> np.ndarray:
        """The quantised count of each key, 0 for keys of other portions or none."""
        out = np.zeros(len(keys), np.uint8)
        seg = _segment(keys, self.segments)
        live = np.flatnonzero(self.bits[seg] > 0)
        for level in range(1, MOST_Q + 1):
            for p in range(probes):
                if not len(live):
                    return out
                s = seg[live]
                spot = _spots(keys[live], level, self.bits[s], p).astype(np.int64)
                live = live[(self.filter[self.base[s] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 > 0]
            out[live] = level
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of tokens; 0 for tokens of other portions or none."""
        if not len(self.tokens):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
        return np.where(self.tokens[at] == keys, self.n[at], 0)


def score(docs: DataFrame, model: DataFrame, probes: int = PROBES, smooth: float = SMOOTH, portion: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs
    (doc_id, text). model as build() makes it.

    Null and empty texts consist of their end token. Whole texts are scored. Only the two
    named columns are read. Repeated rows are scored each for itself. A model of no texts
    gives every token the same probability. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = model.select("segment", (F.length("filter") + F.length("tokens") + F.length("n")).alias("size"), "v", "total", "segments").collect()  # a short row for each segment
    v, total = sum(r["v"] for r in sizes), sum(r["total"] for r in sizes)
    segments = sizes[0]["segments"] if sizes else 1
    portion = portion or portion_of(spark)
    portions: list[list[int]] = [[]]
    held = 0
    for r in sorted(sizes):
        if portions[-1] and held + r["size"] > portion:
            portions.append([])
            held = 0
        portions[-1].append(r["segment"])
        held += r["size"]
    now = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = now.schema["doc_id"].dataType.simpleString()
    for no, own in enumerate(portions):
        first, last = no == 0, no == len(portions) - 1
        rows = [tuple(r)[:4] for r in model.filter(F.col("segment").isin(own)).select("segment", "filter", "tokens", "n").toLocalIterator()] if own else []
        told = spark.sparkContext.broadcast(Portion.packed(segments, rows))
        del rows
        run = _probe(told, probes, smooth, v, total, first, last)
        if last:
            return now.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        was, now = now, staged(now.mapInArrow(tidy(run), f"doc_id {kind}, text string, known long, seen double, q binary"), "lm-levels")
        release(was)
        told.unpersist()
    raise AssertionError


def _probe(told, probes: int, smooth: float, v: int, total: int, first: bool, last: bool):
    floor_ = math.log10(total + 0.5 * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part, value = Hasher(STEP + 1, 31, fold=True), Portion(*told.value), restored()
        for batch in text_steps(batches, most=READ):
            tokens, counts = _tokens(hasher, [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            prev, pairs = _pairs(tokens, counts)
            edge = np.cumsum(counts) - counts
            kinds, no = np.unique(tokens, return_inverse=True)
            exact = part.counts(kinds)
            # a token of another portion has its term there: here it counts as unseen, which adds nothing
            gain = np.log10(exact + 0.5) - math.log10(0.5)
            known, seen = np.add.reduceat((exact > 0)[no].astype(np.int64), edge), np.add.reduceat(gain[no], edge)
            one = part.levels(kinds, probes)[no]
            many, at = np.unique(pairs, return_inverse=True)
            two = part.levels(many, probes)[at]
            if not first:
                known, seen = known + batch.column("known").to_numpy(), seen + batch.column("seen").to_numpy()
                q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.uint8).reshape(-1, 2)
                one, two = np.maximum(one, q[:, 0]), np.maximum(two, q[:, 1])
            if not last:
                q = np.stack((one, two), axis=1)
                rows = [q[a : a + n].tobytes() for a, n in zip(edge.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(known), pa.array(seen), pa.array(rows, pa.binary())], names=["doc_id", "text", "known", "seen", "q"])
                continue
            c1 = value[one]
            before = np.empty_like(c1)
            before[1:] = c1[:-1]
            before[edge] = c1[edge + counts - 1]  # texts begin as often as they end
            uni = (c1 + 0.5) / (total + 0.5 * (v + 1))
            c2 = np.minimum(value[two], before)
            logs = np.log10((c2 + smooth * np.minimum(uni, 1.0)) / (before + smooth))
            base = seen + counts * (math.log10(0.5) - floor_)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(known), pa.array(np.full(len(counts), total)), pa.array(base), pa.array(np.add.reduceat(logs, edge))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of `documents` under a model of those not held out: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = build(docs.filter(~held_out(F.col("doc_id"), 5)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
