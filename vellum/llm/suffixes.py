"""Exact substring deduplication by a sparse suffix array, merged from sorted runs.

Every string of `length` bytes holds an anchor: its gram (a third of it) of least hash
(the leftmost, if several). Equal strings have equal anchors at equal offsets, so only
suffixes that start at anchors are sorted, about one in a hundred positions; and of these
only those whose gram occurs twice or more. With a suffix go the bytes before it
up to the first window that has this anchor.

Each task sorts the suffixes that it cuts out of its texts and sends them, by ranges of the
grams' hashes, as front-coded runs. The receiving task merges the runs with a loser tree
that knows for every contender how many bytes it shares with the last winner: the longer
shared prefix wins unread, and equal ones are compared from there on. The merge yields the
common prefix of every two neighbours; along the tree of these, the bytes before the
suffixes are put in order, smaller sets into larger, and neighbours there with enough bytes
in common on both sides give the windows that occur more than once.

A gram with more than `crowd` distinct surroundings is first split, so that no task holds
more of one gram: the windows around it reach at least halfway out to the left, or else to
the right; they are dealt to the gram longer by as much on that side. Longer grams that occur
once have no repeated window and are dropped, those still crowded are split again, and what
is left goes into the same runs. A split halves the room around the gram, so that a
surrounding is split no oftener than log2(length) times.

Surroundings are taken for equal if two unrelated 64-bit hashes of them agree; all else is
compared byte by byte.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytehash import Hasher
from ._common import join_many, parts, release, staged, table, text_steps, tidy

LENGTH = 400
#: Distinct surroundings of a gram that one task compares.
CROWD = 2048
#: Bytes of suffixes that a task sorts into runs at a time, and that a range of the merge holds, about.
RUN_BYTES, RANGE_BYTES = 32 << 20, 32 << 20
#: An odd number near 2**64 divided by the golden ratio.
SPREAD = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time. Longer texts are taken in segments.
SEGMENT = 1 << 19
KEYS = ["g", "eh", "o"]
FROM = ["og", "oeh", "oo", "on"]


def gram(length: int) -> int:
    """Bytes of the anchors' grams."""
    return max(8, length // 3)


def _pieces(offs: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(document, start, end) of the segments of texts with at least `length` bytes, in
    groups of about SEGMENT bytes. Every window of `length` bytes lies in one segment."""
    group, total = [], 0
    for d in range(len(offs) - 1):
        lo, hi = int(offs[d]), int(offs[d + 1])
        at = lo
        while hi - at >= length:
            end = min(hi, at + SEGMENT)
            group.append((d, at, end))
            total += end - at
            if total >= SEGMENT:
                yield group
                group, total = [], 0
            if end == hi:
                break
            at = end - length + 1
    if group:
        yield group


def _sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """Least of key[i : i + w] for every i."""
    n = len(key)
    pad = -(-n // w) * w
    x = np.full(pad, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = key
    x = x.reshape(-1, w)
    head = np.minimum.accumulate(x, axis=1).ravel()
    tail = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def _anchors(hasher: Hasher, data: memoryview, group: list[tuple[int, int, int]], length: int):
    """Arrays doc, pos (in the whole buffer), o1, o2, gram hash, surroundings' hash: windows
    that start at pos - o2 .. pos - o1 have the anchor at pos."""
    k = gram(length)
    w = length - k + 1
    buf = np.frombuffer(b"".join([data[s:e] for _, s, e in group]), np.uint8)
    size = np.array([e - s for _, s, e in group])
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    prefix = hasher.prefix(buf)
    grams = hasher.grams(prefix, k)
    where = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least((grams & np.uint64(0xFFFFFFFFFF << 24)) | where, w)
    seg = np.repeat(np.arange(len(group)), size)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + length <= (base + size)[seg])
    pos, seg = (least[valid] & np.uint64(0xFFFFFF)).astype(np.int64), seg[valid]
    first = np.flatnonzero(np.append(True, (pos[1:] != pos[:-1]) | (seg[1:] != seg[:-1])))
    last = np.append(first[1:], len(pos)) - 1
    a, lo, hi, seg = pos[first], valid[first], valid[last], seg[first]
    view, around = memoryview(buf), xxhash.xxh3_64_intdigest
    eh = np.array([around(view[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64)
    shift = np.array([s for _, s, _ in group])[seg] - base[seg]
    return np.array([d for d, _, _ in group])[seg], a + shift, a - hi, a - lo, grams[a].view(np.int64), eh.view(np.int64)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """g, eh, o (o1 << 16 | o2), tid, dk, pos for the anchors of every text. docs: tid, dk, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEGMENT + length, 11)
        for batch in text_steps(batches, "body"):
            col = batch.column("body").cast(pa.large_binary())
            offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = memoryview(col.buffers()[2])
            for group in _pieces(offs, length):
                doc, pos, o1, o2, g, eh = _anchors(hasher, data, group, length)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(eh), pa.array((o1 << 16 | o2).astype(np.int32)), batch.column("tid").take(doc), batch.column("dk").take(doc), pa.array((pos - offs[doc]).astype(np.int64))],
                    names=["g", "eh", "o", "tid", "dk", "pos"],
                )

    return docs.select("tid", "dk", "body").mapInArrow(tidy(run), "g long, eh long, o int, tid binary, dk long, pos long")


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that a and b have in common, given that the first `start` are."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    return start + (n - start) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


# ---- runs and their merge -------------------------------------------------------------


def front_coded(items: list[tuple[bytes, tuple]]) -> bytes:
    """A sorted run: for each (string, payload) the bytes shared with the one before, and the rest."""
    items.sort(key=lambda x: x[0])
    out, was = [], b""
    for s, payload in items:
        n = shared_prefix(was, s)
        out.append((n, s[n:], payload))
        was = s
    return pickle.dumps(out, protocol=5)


def _opened(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    was = b""
    for n, rest, payload in pickle.loads(run):
        was = was[:n] + rest
        yield n, was, payload


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, tuple]]:
    """All strings of the runs in order: (bytes shared with the string before, string, payload).

    A loser tree. Every contender carries its shared prefix with the last winner: the run
    it comes from was sorted against that winner or has lost to it. Of two contenders the
    one that shares more is smaller; if both share as much, they differ from there on and
    what they turn out to share becomes the loser's shared prefix."""
    sources = [_opened(r) for r in runs]
    k = 1
    while k < len(sources):
        k *= 2
    END = (0, None, None)
    now = [next(s, END) for s in sources] + [END] * (k - len(sources))
    lcp = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """winner, loser"""
        x, y = now[a][1], now[b][1]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] > lcp[b]:
            return a, b
        if lcp[b] > lcp[a]:
            return b, a
        n = shared_prefix(x, y, lcp[a])
        if x[n : n + 1] <= y[n : n + 1]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    tree = [0] * k  # losers; the leaves are k .. 2k - 1

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        tree[node] = lost
        return won

    best = build(1) if k > 1 else 0
    while now[best][1] is not None:
        yield lcp[best], now[best][1], now[best][2]
        now[best] = nxt = next(sources[best], END) if best < len(sources) else END
        lcp[best] = nxt[0]
        node = (best + k) // 2
        while node:
            won, lost = play(best, tree[node])
            tree[node], best = lost, won
            node //= 2


# ---- windows that occur more than once --------------------------------------------------


def repeated_windows(items: list[tuple[int, bytes, int, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For suffixes of one anchor string in sorted order, each (bytes shared with the one
    before, bytes before it reversed, o1, o2, copies): the offsets o, as (lo, hi) ranges,
    for which `length` bytes from o before the anchor on occur in two copies or more."""
    found: list[list[tuple[int, int]]] = [[(o1, o2)] if n > 1 else [] for _, _, o1, o2, n in items]
    before = [x[1] for x in items]

    def meet(i: int, j: int, depth: int) -> None:
        most, least = shared_prefix(before[i], before[j]), length - depth
        if most >= least:
            for x in (i, j):
                lo, hi = max(least, items[x][2]), min(most, items[x][3])
                if lo <= hi:
                    found[x].append((lo, hi))

    def join(a: list, b: list, depth: int) -> list:
        if len(a) < len(b):
            a, b = b, a
        for key in b:
            at = bisect_left(a, key)
            if at:
                meet(a[at - 1][1], key[1], depth)
            if at < len(a):
                meet(a[at][1], key[1], depth)
            a.insert(at, key)
        return a

    stack: list[tuple[int, list]] = []
    for i, (lcp, left, *_) in enumerate(items):
        while len(stack) > 1 and stack[-1][0] > lcp:
            depth, own = stack.pop()
            up, held = stack[-1]
            if up >= lcp:
                stack[-1] = (up, join(held, own, up))
            else:
                stack.append((lcp, own))
                break
        if stack and stack[-1][0] > lcp:
            stack[-1] = (lcp, stack[-1][1])
        # the new suffix joins the node of depth lcp, now on top
        if stack and stack[-1][0] == lcp:
            stack.append((1 << 60, [(left, i)]))
        else:
            stack.append((lcp, [])) if stack else None
            stack.append((1 << 60, [(left, i)]))
    while len(stack) > 1:
        _, own = stack.pop()
        up, held = stack[-1]
        stack[-1] = (up, join(held, own, up))
    return found


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut_runs(length: int, ranges: int):
    """Rows (body, what) to front-coded runs, one for each range of the grams' hashes. An item
    of `what` names its surroundings by g, eh, o, or by og, oeh, oo if it has these; where they
    are null, its windows are known and only others' are sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([front_coded(held.pop(k)) for k in keys], pa.binary())], names=["range", "run"])

        for batch in text_steps(batches, "body"):
            for body, what in zip(batch.column("body"), batch.column("what").to_pylist(), strict=True):
                data = memoryview(body.as_buffer())
                for x in what:
                    a, o1, o2, g = x["pos"], x["o"] >> 16, x["o"] & 0xFFFF, x["g"] & ((1 << 64) - 1)
                    name = (x["og"], x["oeh"], x["oo"], x["on"]) if "og" in x else (x["g"], x["eh"], x["o"], x["n"])
                    item = (g.to_bytes(8, "big") + bytes(data[a : a - o1 + length]), (bytes(data[a - o2 : a])[::-1], g, x["eh"], x["o"], x["n"], name))
                    # anchors have small hashes: multiplied, they spread over all ranges
                    held.setdefault((g * SPREAD & ((1 << 64) - 1)) * ranges >> 64, []).append(item)
                    size += 2 * length
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _merge_runs(length: int):
    """Runs of a range to (g, eh, o, w, lo, hi): the windows at offsets lo..hi occur repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[bytes]] = {}
        for batch in batches:
            for r, x in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), strict=True):
                own.setdefault(r, []).append(x)
        for r in sorted(own):
            out: list[tuple] = []
            group: list[tuple] = []
            names: list[tuple] = []

            def close():
                for name, got in zip(names, repeated_windows(group, length), strict=True):  # noqa: B023
                    if name[0] is not None:
                        out.extend((*name, lo, hi) for lo, hi in _joined(got))  # noqa: B023
                group.clear()  # noqa: B023
                names.clear()  # noqa: B023

            at, known, skipped = None, set(), None
            for lcp, _, (left, g, eh, o, n, name) in merged(own.pop(r)):
                if g != at:
                    close()
                    at, known, skipped = g, set(), None
                lcp -= 8
                if (eh, o) in known:  # the same text twice in the input of this step
                    skipped = lcp if skipped is None else min(skipped, lcp)
                    continue
                if skipped is not None:
                    lcp, skipped = min(lcp, skipped), None
                known.add((eh, o))
                names.append(name)
                group.append((lcp, left, o >> 16, o & 0xFFFF, n))
            close()
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["g", "eh", "o", "w", "lo", "hi"])

    return run


# ---- grams with too many surroundings ----------------------------------------------------

#: A surrounding: where it comes from, its bytes, the anchor's place in them, bytes that the
#: gram is longer to the left and right, and the offsets of its windows as o.
AROUND = "og long, oeh long, oo int, on long, n long, sur binary, pos long, el int, er int, o int"
CHILD = "g long, eh long, " + AROUND


def _surroundings(length: int):
    """Rows (body, what) to a row for each surrounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "body", 1 << 20):
            rows = []
            for body, what in zip(batch.column("body"), batch.column("what").to_pylist(), strict=True):
                data = memoryview(body.as_buffer())
                for x in what:
                    a, o1, o2 = x["pos"], x["o"] >> 16, x["o"] & 0xFFFF
                    rows.append((x["g"], x["eh"], x["o"], x["n"], x["n"], bytes(data[a - o2 : a - o1 + length]), o2, 0, 0, x["o"]))
            yield _batch(rows, AROUND)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(cols, kinds, strict=True)], names=names)


def _split(length: int):
    """Each surrounding to its two halves, named by the hash of the longer gram."""
    k, signed = gram(length), lambda h: h - (1 << 64) if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "sur", 1 << 20):
            rows = []
            for x in batch.to_pylist():
                el, er, a, lo, hi = x["el"], x["er"], x["pos"], x["o"] >> 16, x["o"] & 0xFFFF
                room = length - k - el - er
                half = (room + 1) // 2
                for left, right, first, last in ((el + half, er, max(lo, el + half), hi), (el, er + room - half + 1, lo, min(hi, el + half - 1))):
                    if first > last:
                        continue
                    sur = x["sur"][a - last : a - first + length]
                    g = xxhash.xxh3_64_intdigest(sur[last - left : last + k + right], left << 16 | right)
                    rows.append((signed(g), signed(xxhash.xxh3_64_intdigest(sur)), x["og"], x["oeh"], x["oo"], x["on"], x["n"], sur, last, left, right, first << 16 | last))
            yield _batch(rows, CHILD)

    return run


def _uncrowded(around: DataFrame, length: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Splits surroundings until no gram has more than `crowd`: rows (body, what) for the runs,
    and rows (g, eh, o, w, lo, hi) of windows that the splits have found repeated."""
    calm, solved = [], []
    named = F.struct(*FROM)
    while True:
        children = staged(around.mapInArrow(tidy(_split(length)), CHILD), "suffix-children")
        twice = staged(children.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).filter("n > 1").select("g", "c"), "suffix-twice")
        cand = staged(join_many(children, twice, ["g"], "c"), "suffix-candidates")
        release(children, twice, around)
        kinds = cand.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.first("el").alias("el"), F.first("er").alias("er"), F.first("pos").alias("pos"), F.min(named).alias("own"), F.first("sur").alias("sur"))
        kinds = staged(kinds, "suffix-kinds")
        same = join_many(cand.filter("og is not null"), kinds.filter("n > 1").select(*KEYS, "c"), KEYS, "c")
        solved.append(staged(same.select(F.col("og").alias("g"), F.col("oeh").alias("eh"), F.col("oo").alias("o"), F.col("on").alias("w"), F.shiftright("o", 16).alias("lo"), F.col("o").bitwiseAND(0xFFFF).alias("hi")), "suffix-solved"))
        release(cand)
        own = F.when(F.col("n") == 1, F.col("own"))
        rest = kinds.select(*KEYS, "n", "sur", "pos", "el", "er", *[own[c].alias(c) for c in FROM])
        sizes = rest.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.count("og").alias("open"))
        sizes = staged(sizes, "suffix-sizes")
        crowded = staged(sizes.filter((F.col("m") > crowd) & (F.col("open") > 0)).select("g", "m"), "suffix-crowds")
        small = sizes.filter((F.col("m") <= crowd) & (F.col("m") > 1) & (F.col("open") > 0)).select("g")
        item = F.struct(*KEYS, "pos", "n", *FROM)
        calm.append(staged(rest.join(small, "g", "left_semi").select(F.col("sur").alias("body"), F.array(item).alias("what")), "suffix-calm"))
        if crowded.isEmpty():
            release(kinds, sizes, crowded)
            return calm, solved
        around = staged(join_many(rest, crowded, ["g"], "m").select(*FROM, "n", "sur", "pos", "el", "er", "o"), "suffix-around")
        release(kinds, sizes, crowded)


def repeated_spans(docs: DataFrame, length: int, crowd: int = CROWD) -> DataFrame:
    """tid, starts: for each text (docs: tid, dk, body) the ranges (lo, hi) of the positions at
    which a string of `length` bytes begins that also begins elsewhere."""
    spark = docs.sparkSession
    every = staged(anchors(docs, length), "suffix-anchors")
    twice = staged(every.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "suffix-twice")
    cand = staged(join_many(every, twice, ["g"], "c"), "suffix-candidates")
    release(every, twice)
    kinds = staged(cand.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "dk", "pos")).alias("at")), "suffix-kinds")
    full = staged(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > crowd).select("g", F.lit(True).alias("hot")), "suffix-crowds")
    marked = kinds.join(full, "g", "left").select(*KEYS, "n", "at.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    need = marked.groupBy("tid", "dk").agg(
        F.collect_list(F.when(~F.col("hot"), F.struct(*KEYS, "pos", "n"))).alias("calm"),
        F.collect_list(F.when(F.col("hot"), F.struct(*KEYS, "pos", "n"))).alias("hot"),
    )
    # rows equal in text and id may be any share of all: they stay where they are, and one of them is cut
    times = docs.groupBy("tid", "dk").agg(F.count(F.lit(1)).alias("rows"), _weight().alias("c"))
    need = staged(need.join(times, ["tid", "dk"]), "suffix-need")
    texts = join_many(docs, need.drop("rows"), ["tid", "dk"], "c")
    if (need.agg(F.max("rows")).first()[0] or 0) > 1:
        texts = texts.dropDuplicates(["tid", "dk"])
    texts = staged(texts.select("body", "calm", "hot"), "suffix-texts")
    release(need)
    calm, solved = [], []
    if not full.isEmpty():
        around = texts.filter(F.size("hot") > 0).select("body", F.col("hot").alias("what")).mapInArrow(tidy(_surroundings(length)), AROUND)
        # rows equal in text and id come once each
        calm, solved = _uncrowded(staged(around.dropDuplicates(["og", "oeh", "oo"]), "suffix-around"), length, crowd)
    ranges = max(4 * parts(spark), 16, sum(k.count() for k in (kinds, *calm)) * 2 * length // RANGE_BYTES)
    cut, runs = tidy(_cut_runs(length, ranges)), "range int, run binary"
    runs_of = [texts.filter(F.size("calm") > 0).select("body", F.col("calm").alias("what")).mapInArrow(cut, runs)]
    runs_of += [x.mapInArrow(cut, runs) for x in calm]
    found = _all(runs_of).repartition(ranges, "range").mapInArrow(tidy(_merge_runs(length)), "g long, eh long, o int, w long, lo int, hi int")
    found = _all([found, *solved]).groupBy(*KEYS).agg(F.first("w").alias("w"), F.collect_list(F.struct("lo", "hi")).alias("got"))
    found = staged(found, "suffix-found")
    release(kinds, full, texts, *calm, *solved)
    places = join_many(cand.dropDuplicates(["tid", "pos", *KEYS]), found, KEYS, "w")
    at = F.explode(F.transform("got", lambda r: F.struct((F.col("pos") - r["hi"]).alias("lo"), (F.col("pos") - r["lo"]).alias("hi"))))
    spans = staged(places.select("tid", at.alias("r")).groupBy("tid").agg(F.collect_set("r").alias("starts")), "suffix-spans")
    release(cand, found)
    return spans


def _weight() -> Column:
    """Of texts that a key holds, for join_many: KiB of them, so that a few long copies count as many short ones do."""
    return F.sum(F.ceil((F.octet_length("body") + 1) / 1024)).cast("long")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _char_start(body: bytes, at: int, step: int) -> int:
    """The nearest place from `at` on, in steps of 1 or -1, at which a character begins or the text ends."""
    while 0 < at < len(body) and body[at] & 0xC0 == 0x80:
        at += step
    return at


def remove_repeats(df: DataFrame, length: int = LENGTH, crowd: int = CROWD, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", least_words: int = 0, whole_chars: bool = False) -> DataFrame:
    """The kept columns, n_bytes, spans (array of start, end: the maximal removed runs of
    bytes) and kept (binary: the bytes that remain). One row per input row.

    A byte goes if a string of `length` bytes that covers it begins at another place too, in
    this text or another. A run of such bytes with fewer than least_words words stays;
    whole_chars: of a character that the end of a run divides, all bytes go. Null and empty texts have no bytes; texts shorter than `length` keep all.
    Repeated rows are texts of their own, so from `length` bytes on they go wholly. Other
    columns are ignored; the names n_bytes, spans and kept are not free to be kept. An empty
    table gives an empty result.
    """
    if not 16 <= length < 1 << 15:
        raise ValueError("length must lie between 16 and 32767")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(*keep, body.alias("body"), F.xxhash64(F.col(doc_id)).alias("dk"))
    long = rows.filter(F.octet_length("body") >= length).withColumn("tid", F.unhex(F.md5("body")))
    spans = repeated_spans(long.select("tid", "dk", "body"), length, crowd)
    # copies of one text may be any share of all rows
    times = staged(long.groupBy("tid").agg(_weight().alias("c")).join(spans, "tid", "left"), "suffix-times")
    done = join_many(long, times, ["tid"], "c").select(*keep, "body", "starts")
    short = rows.filter(F.octet_length("body") < length).select(*keep, "body", F.lit(None).cast(spans.schema["starts"].dataType).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, "body"):
            sizes, all_spans, kept = [], [], []
            for body, starts in zip(batch.column("body").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                gone = [(lo, hi + 1) for lo, hi in _joined([(r["lo"], r["hi"] + length - 1) for r in starts or ()])]
                gone = [(lo, hi) for lo, hi in gone if not least_words or len(body[lo:hi].split()) >= least_words]
                if whole_chars:
                    gone = [(lo, hi - 1) for lo, hi in ((_char_start(body, lo, -1), _char_start(body, hi, 1)) for lo, hi in gone)]
                    gone = [(lo, hi + 1) for lo, hi in _joined(gone)]
                at, left = 0, []
                for lo, hi in gone:
                    left.append(body[at:lo])
                    at = hi
                left.append(body[at:])
                sizes.append(len(body))
                all_spans.append([{"start": lo, "end": hi} for lo, hi in gone])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[*keep, "n_bytes", "spans", "kept"],
            )

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return done.unionByName(short).mapInArrow(tidy(run), f"{fields}, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without their repeated strings of 400 bytes: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, and text: the bytes kept, with U+FFFD for parts of characters."""
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
