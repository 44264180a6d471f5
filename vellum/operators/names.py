"""Names in texts.

As long as the names are few bytes, they go to every task as an Aho-Corasick automaton. More of them stay where they are: a
name stands in a text as a run of whole tokens (words, or single characters between them), so each text looks up its runs of
as many tokens as some name has, by hash, in a Bloom filter of all names, and only the runs found there are joined to the
names, by their characters. The driver sees the filter, which is a few bits a name and bounded, and the names' token counts.
Neither texts nor words are shuffled, a word that stands in every text or in every name is no key of anything, and a name
that stands in very many texts is dealt to several tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged

#: Bytes of names and nodes, about, up to which they are broadcast.
SHARD_BYTES = 16 << 20
#: Names of a block of the filter, bits of its size (16 bits a name), blocks at most: the filter has 64 MiB at most.
BLOCK_NAMES, BLOCK_BITS, MOST_BLOCKS = 1 << 15, 19, 1 << 10
#: Tokens of a run that is looked up at every place. Longer names are sought where their beginning is found.
MOST_TOKENS = 32
#: Characters of texts that are looked up at a time. Longer texts are taken in pieces.
STEP = 1 << 18
#: Texts with one name that a task joins, about.
CROWD = 1 << 18

#: The automaton that this worker used last, by the shard's name.
_last: dict[str, tuple] = {}


def word_character(c: str) -> bool:
    """A letter, mark, decimal digit, letter number, connector or joiner, or the hyphen: no name begins or ends next to one."""
    return c == "-" or c in "‌‍" or "Ⓐ" <= c <= "ⓩ" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc")


def _automaton(name: str, told) -> ahocorasick.Automaton:
    if name not in _last:
        auto = ahocorasick.Automaton()
        for called, nodes in told.value.items():
            auto.add_word(called, (len(called), nodes))
        auto.make_automaton()
        _last.clear()
        _last[name] = auto
    return _last[name]


def _scan(name: str, told):
    def run(batches):
        auto = _automaton(name, told)
        for batch in batches:
            at, nodes, sizes = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                best: dict = {}
                for end, (n, found) in auto.iter(text or ""):
                    begin, after = end - n, end + 1
                    if (begin < 0 or not word_character(text[begin])) and (after == len(text) or not word_character(text[after])):
                        for node in found:
                            if best.get(node, 0) < n:
                                best[node] = n
                at += [i] * len(best)
                nodes += best.keys()
                sizes += best.values()
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(nodes, pa.string()), pa.array(sizes, pa.int32())], names=["id", "node", "size"])

    return run


# ---- runs of tokens, by hash -------------------------------------------------------------

#: Tables of this worker: what characters are (2: not asked yet), powers of BASE and of its inverse. Tasks are sent without them.
_tables: dict[str, np.ndarray] = {}
BASE = 0x9E3779B97F4A7C15


def _is_word(chars: np.ndarray) -> np.ndarray:
    if "word" not in _tables:
        _tables["word"] = np.full(0x110000, 2, np.uint8)
    kind = _tables["word"][chars]
    if (kind == 2).any():
        for c in np.unique(chars[kind == 2]).tolist():
            _tables["word"][c] = word_character(chr(c))
        kind = _tables["word"][chars]
    return kind == 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            _tables[name] = np.cumprod(np.append(np.uint64(1), np.full(max(n, STEP), base, np.uint64)))
    return _tables["up"], _tables["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


class _Tokens:
    """The tokens of some texts: begin, end (characters of all texts together), of (the text), opens and closes (whether a name
    may begin or end there)."""

    def __init__(self, texts: list[str]):
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, ends = len(chars), np.cumsum([len(t) for t in texts])
        word = _is_word(chars)
        border = np.zeros(n + 1, bool)
        border[0] = True
        border[ends] = True
        before = np.append(False, word[:-1])[:n] & ~border[:n]
        self.begin = np.flatnonzero(border[:n] | ~word | ~before)
        self.end = np.append(self.begin[1:], n)[: len(self.begin)]
        self.of = np.searchsorted(ends, self.begin, "right")
        self.base = ends - [len(t) for t in texts]
        self.opens = ~before[self.begin]
        self.closes = border[self.end] | ~np.append(word, False)[self.end]
        up, self.down = _powers(n + 1)
        self.sums = np.append(np.uint64(0), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:n]))

    def hashed(self, first: np.ndarray, tokens: int) -> np.ndarray:
        """Of the runs of so many tokens from these on: equal for equal characters."""
        a, b = self.begin[first], self.end[first + tokens - 1]
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a])

    def runs(self, first: np.ndarray, tokens: int, closed: bool = True) -> np.ndarray:
        """Those of `first` at which a run of so many tokens begins, and ends where a name may."""
        first = first[first + tokens <= len(self.begin)]
        last = first + tokens - 1
        return first[(self.of[first] == self.of[last]) & (self.closes[last] if closed else True)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names to their tokens and hashes; of names over MOST_TOKENS, with 0 for tokens, the inverted hash of their beginning too."""
    for batch in batches:
        for part in _steps(batch, "called"):
            t = _Tokens(part.column("called").to_pylist())
            first = np.flatnonzero(np.append(True, t.of[1:] != t.of[:-1]))
            many = np.diff(np.append(first, len(t.begin)))
            h = np.zeros(len(first), np.uint64)
            for k in np.unique(many).tolist():
                h[many == k] = t.hashed(first[many == k], k)
            long = first[many > MOST_TOKENS]
            h, many = np.append(h, ~t.hashed(long, MOST_TOKENS)), np.append(many, np.zeros(len(long), many.dtype))
            yield pa.RecordBatch.from_arrays([pa.array(many.astype(np.int32)), pa.array(h.view(np.int64))], names=["tokens", "h"])


def _steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP bytes of the column, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, "right")))
        yield batch.slice(at, end - at)
        at = end


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of a hash, and its bits there."""
    least = np.uint64((1 << BLOCK_BITS) - 1)
    return ((h >> np.uint64(2 * BLOCK_BITS)) % np.uint64(blocks)).astype(np.int64), [(h & least).astype(np.int64), ((h >> np.uint64(BLOCK_BITS)) & least).astype(np.int64)]


def _filled(blocks: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, bool)
        for at in _places(rows.column("h").to_numpy().view(np.uint64), blocks)[1]:
            bits[at] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def _block_of(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column("h").to_numpy().view(np.uint64), blocks)[0].astype(np.int32)), batch.column("h")], names=["block", "h"])

    return run


def _pieces(texts: list, longest: int) -> Iterator[list[tuple[int, str, int, int]]]:
    """(text, piece of it, and the places in the piece at which a name may begin: from, to), about STEP characters at a time. A
    piece has the character before these places, and as many behind them as a name needs."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), STEP):
            piece = text[max(0, at - 1) : at + STEP + longest + 1]
            lead = 1 if at else 0
            held.append((i, piece, lead, lead + STEP))
            size += len(piece)
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hits(told, blocks: int, counts: list[int], longest: int):
    """Batches of (id, text) to (id, called): the runs of tokens that the filter takes for names, each once for a text."""
    short, long = [k for k in counts if k <= MOST_TOKENS], [k for k in counts if k > MOST_TOKENS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value

        def held(h: np.ndarray) -> np.ndarray:
            block, places = _places(h, blocks)
            out = np.ones(len(h), bool)
            for at in places:
                at = (block << BLOCK_BITS) + at
                out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            return out

        for batch in batches:
            for part in _steps(batch, "text"):
                for pieces in _pieces(part.column("text").to_pylist(), longest):
                    t = _Tokens([p[1] for p in pieces])
                    own = t.begin - t.base[t.of]
                    lo, hi = (np.array([p[x] for p in pieces])[t.of] for x in (2, 3))
                    every = np.flatnonzero(t.opens & (own >= lo) & (own < hi))
                    found = set()
                    heads = every[:0]
                    if long:
                        heads = t.runs(every, MOST_TOKENS, False)
                        heads = heads[held(~t.hashed(heads, MOST_TOKENS))]
                    for k, first in [*((k, every) for k in short), *((k, heads) for k in long)]:
                        first = t.runs(first, k)
                        first = first[held(t.hashed(first, k))]
                        of, base = t.of[first], t.base[t.of[first]]
                        for p, a, b in zip(of.tolist(), (t.begin[first] - base).tolist(), (t.end[first + k - 1] - base).tolist(), strict=True):
                            found.add((pieces[p][0], pieces[p][1][a:b]))
                    rows = sorted(found)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string())], names=["id", "called"])

    return run


def _joined(texts: DataFrame, names: DataFrame, crowd: int = CROWD) -> DataFrame:
    """id, node, size of names of any number."""
    spark = texts.sparkSession
    names = staged(names, "names")
    keys = staged(names.select("called").distinct().mapInArrow(_keys, "tokens int, h long").distinct(), "name-keys")
    counts = sorted(r["tokens"] for r in keys.select("tokens").distinct().collect() if r["tokens"])
    longest = names.agg(F.max(F.length("called"))).first()[0]
    blocks = min(MOST_BLOCKS, -(-keys.count() // BLOCK_NAMES))
    bits = np.zeros(blocks << BLOCK_BITS - 3, np.uint8)
    filled = keys.select("h").mapInArrow(_block_of(blocks), "block int, h long").groupBy("block").applyInArrow(_filled(blocks), "block int, bits binary")
    for r in filled.toLocalIterator():
        bits[r["block"] << BLOCK_BITS - 3 : r["block"] + 1 << BLOCK_BITS - 3] = np.frombuffer(r["bits"], np.uint8)
    told = spark.sparkContext.broadcast(bits)
    hits = staged(texts.mapInArrow(_hits(told, blocks, counts, longest), f"id {texts.schema['id'].dataType.simpleString()}, called string"), "name-hits")
    told.destroy()
    release(keys)
    heavy = staged(hits.groupBy("called").count().filter(F.col("count") > crowd).select("called", F.ceil(F.col("count") / crowd).cast("int").alias("deals")), "name-crowds")
    deals = F.coalesce("deals", F.lit(1))
    dealt = lambda df, salt: df.join(F.broadcast(heavy), "called", "left").withColumn("deal", salt).drop("deals")
    many = dealt(hits, F.pmod(F.xxhash64("id"), deals).cast("int"))
    return many.join(dealt(names, F.explode(F.sequence(F.lit(0), deals - 1))).hint("merge"), ["called", "deal"]).select("id", "node", F.length("called").alias("size"))


def named(texts: DataFrame, names: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, node, size: the nodes whose name (names: node, called; texts both) stands in a text (texts: id, text) with neither a word
    character nor a hyphen next to it, and the length of the longest such name. Case counts.

    A node may have many names and a name many nodes. Null texts hold nothing; null and empty names stand nowhere. Names of over
    shard_bytes do not pass through the driver."""
    spark = texts.sparkSession
    names = names.select(F.col("node").cast("string").alias("node"), "called").filter("called <> '' and node is not null").distinct()
    held = names.agg(F.sum(F.octet_length("called") + F.octet_length("node") + 32)).first()[0] or 0
    texts = texts.select("id", F.col("text").cast("string").alias("text"))
    kind = f"id {texts.schema['id'].dataType.simpleString()}, node string, size int"
    if not held:
        return spark.createDataFrame([], kind)
    if held > shard_bytes:
        found = _joined(texts, names)
    else:
        own: dict[str, list[str]] = {}
        for called, node in names.select("called", "node").toLocalIterator():
            own.setdefault(called, []).append(node)
        found = texts.mapInArrow(_scan(uuid4().hex, spark.sparkContext.broadcast(own)), kind)
    return found.groupBy("id", "node").agg(F.max("size").alias("size"))
