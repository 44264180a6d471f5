"""Byte-level BPE by a rank queue in a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair whose joined bytes are in
the vocabulary waits in the bucket of its rank, by list position. Two bitmap levels
say which buckets hold anything: a summary word points at 256-bit words, and finding
the first set bit in each gives the lowest waiting rank in constant time. Entries that
a merge made stale are recognised when they are taken out and skipped, so a pre-token
of n bytes takes O(n log n), however long it is.

The pre-tokens that a step of texts brings anew share one queue: their lists stand one
behind the other with marks between them, and a rank is looked for once for all of them.
"""

from __future__ import annotations

import hashlib
import base64
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_steps, texts_of, tidy

#: Distinct pre-tokens whose ids a worker remembers before it forgets the older ones.
CACHE = 600_000
#: Bytes of a pre-token whose positions are kept as bit sets.
SHORT = 128
#: Code points of a pre-token that is remembered.
KEPT = 64
#: Bytes of text whose new pre-tokens are encoded together; of a text with more pre-tokens than PIECES, so many at a time.
STEP, PIECES = 1 << 20, 1 << 18
#: Bytes of the pre-tokens that share a queue.
SHARED = 1 << 18
#: In a shared queue's list: what stands before and behind each pre-token (pairs with it have negative
#: keys, which no vocabulary holds), and what a merge has taken up.
MARK, GONE = -1, -2


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank, from a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pre-token pattern of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Merges:
    """A vocabulary's ids, and the rank of every pair of tokens that may join."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.byte) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.shift = max(ranks.values()).bit_length()
        join = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    join[left << self.shift | right] = rank
        self.join = join
        self._pairs = None

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """For each pre-token its ids as little-endian 32-bit words."""
        out: list = [None] * len(pieces)
        part, size = [], 0
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = _words32([whole])
            elif len(piece) < 2:
                out[i] = _words32([self.byte[b] for b in piece])
            else:
                part.append(i)
                size += len(piece)
                if size >= SHARED:
                    self._merged_shared(pieces, part, out)
                    part, size = [], 0
        if part:
            self._merged_shared(pieces, part, out)
        return out

    def _byte_pairs(self):
        """Of bytes: their ids; of two bytes, the first the higher: the rank of their pair, or -1."""
        import numpy as np

        if self._pairs is None:
            join, shift = self.join.get, self.shift
            pairs = [join(a << shift | b, -1) for a in self.byte for b in self.byte]
            self._pairs = np.array(self.byte, np.int64), np.array(pairs, np.int64)
        return self._pairs

    def _merged_shared(self, pieces: list[bytes], part: list[int], out: list) -> None:
        """One queue for many pre-tokens: buckets are lists of positions in all of them. A pre-token's
        own lowest rank is never passed over, since no rank below the one at hand waits anywhere;
        if a merge brings one up, the pre-token is done again by itself."""
        import numpy as np

        byte, pairs = self._byte_pairs()
        join, shift = self.join.get, self.shift
        chosen = [pieces[i] for i in part]
        raw = np.frombuffer(b"\0" + b"\0".join(chosen) + b"\0", np.uint8)
        n = len(raw)
        ends = np.cumsum(np.array([0, *(len(p) + 1 for p in chosen)]))
        ids = byte[raw]
        ids[ends] = MARK
        due = np.full(n, -1)
        due[:-1] = pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        due[ends] = due[ends[1:] - 1] = -1
        at = np.flatnonzero(due >= 0)
        at = at[np.argsort(due[at], kind="stable")]
        first = np.flatnonzero(np.diff(due[at], prepend=-1))
        places, bounds = at.tolist(), [*first.tolist(), len(at)]
        waiting = {r: places[a:b] for r, a, b in zip(due[at[first]].tolist(), bounds[:-1], bounds[1:], strict=True)}
        words, summary = self._queue(waiting)
        ids, due, odd = ids.tolist(), due.tolist(), []
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            word &= word - 1
            words[high] = word
            if not word:
                summary &= summary - 1
            bucket = waiting.pop(rank)
            bucket.sort()
            left = rank << shift
            for at in bucket:
                if due[at] != rank:
                    continue  # stale: a merge has changed one of the two
                mate = after[at]
                ids[at], ids[mate], due[mate] = rank, GONE, -1
                nxt = after[at] = after[mate]
                before[nxt] = at
                back = before[at]
                new = due[at] = join(left | ids[nxt], -1)
                older = due[back] = join(ids[back] << shift | rank, -1)
                if new >= 0:
                    if new in waiting:
                        waiting[new].append(at)
                    else:
                        waiting[new] = [at]
                        words[new >> 8] = words.get(new >> 8, 0) | 1 << (new & 255)
                        summary |= 1 << (new >> 8)
                    if new < rank:
                        odd.append(at)
                if older >= 0:
                    if older in waiting:
                        waiting[older].append(back)
                    else:
                        waiting[older] = [back]
                        words[older >> 8] = words.get(older >> 8, 0) | 1 << (older & 255)
                        summary |= 1 << (older >> 8)
                    if older < rank:
                        odd.append(at)
        ids = np.array(ids)
        ids = ids[ids != GONE]
        cuts = np.flatnonzero(ids == MARK).tolist()
        blob = ids.astype("<u4").tobytes()
        for i, lo, hi in zip(part, cuts[:-1], cuts[1:], strict=True):
            out[i] = blob[4 * lo + 4 : 4 * hi]
        for k in np.unique(np.searchsorted(ends, odd) - 1).tolist():
            out[part[k]] = _words32(self.encode_piece(chosen[k]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [*map(self.byte.__getitem__, piece)]
        n = len(ids)
        if n < 2:
            return ids
        # waiting: rank to the list positions that wait there
        return self._merged_short(ids) if n <= SHORT else self._merged_long(ids)

    @staticmethod
    def _queue(ranks) -> tuple[dict[int, int], int]:
        """The bitmap's words and summary for buckets that hold something."""
        words: dict[int, int] = {}
        summary = 0
        for rank in ranks:
            high = rank >> 8
            if summary >> high & 1:
                words[high] |= 1 << (rank & 255)
            else:
                words[high] = 1 << (rank & 255)
                summary |= 1 << high
        return words, summary

    def _merged_short(self, ids: list[int]) -> list[int]:
        """Buckets are bit sets of positions: most pre-tokens are words."""
        join, shift, n = self.join.get, self.shift, len(ids)
        waiting: dict[int, int] = {}
        due = []  # the rank at which each position waits; -1: none
        left, bit = ids[0], 1
        for right in ids[1:]:
            rank = join(left << shift | right, -1)
            due.append(rank)
            if rank >= 0:
                waiting[rank] = waiting.get(rank, 0) | bit
            left = right
            bit += bit
        words, summary = self._queue(waiting)
        if not summary:
            return ids
        due.append(-1)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = waiting[rank]
            at = (bucket & -bucket).bit_length() - 1
            bucket &= bucket - 1
            waiting[rank] = bucket
            if not bucket:
                word &= word - 1
                words[high] = word
                if not word:
                    summary &= summary - 1
            if due[at] != rank:
                continue  # stale: a merge has changed one of the two
            mate = after[at]
            ids[at], ids[mate], due[mate] = rank, -1, -1
            nxt = after[at] = after[mate]
            if nxt < n:
                before[nxt] = at
                new = due[at] = join(rank << shift | ids[nxt], -1)
                if new >= 0:
                    waiting[new] = waiting.get(new, 0) | 1 << at
                    high = new >> 8
                    words[high] = words.get(high, 0) | 1 << (new & 255)
                    summary |= 1 << high
            else:
                due[at] = -1
            at = before[at]
            if at >= 0:
                new = due[at] = join(ids[at] << shift | rank, -1)
                if new >= 0:
                    waiting[new] = waiting.get(new, 0) | 1 << at
                    high = new >> 8
                    words[high] = words.get(high, 0) | 1 << (new & 255)
                    summary |= 1 << high
        return [i for i in ids if i >= 0]

    def _merged_long(self, ids: list[int]) -> list[int]:
        """Buckets are heaps of positions."""
        join, shift, n = self.join.get, self.shift, len(ids)
        waiting: dict[int, list[int]] = {}
        for at in range(n - 1):
            rank = join(ids[at] << shift | ids[at + 1])
            if rank is not None:
                waiting.setdefault(rank, []).append(at)  # rising positions keep the heap in order
        words, summary = self._queue(waiting)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = waiting[rank]
            at = heappop(bucket)
            if not bucket:
                words[high] = word & (word - 1)
                if not words[high]:
                    summary &= summary - 1
            own, mate = ids[at], after[at]
            if own < 0 or mate >= n or join(own << shift | ids[mate]) != rank:
                continue  # stale
            ids[at], ids[mate] = rank, -1
            nxt = after[at] = after[mate]
            made = []
            if nxt < n:
                before[nxt] = at
                made.append((join(rank << shift | ids[nxt]), at))
            if before[at] >= 0:
                made.append((join(ids[before[at]] << shift | rank), before[at]))
            for new, where in made:
                if new is not None:
                    heappush(waiting.setdefault(new, []), where)
                    words[new >> 8] = words.get(new >> 8, 0) | 1 << (new & 255)
                    summary |= 1 << (new >> 8)
        return [i for i in ids if i >= 0]


def _words32(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit words."""
    out = array("I", ids)
    if out.itemsize != 4 or sys.byteorder != "little":
        return b"".join(i.to_bytes(4, "little") for i in ids)
    return out.tobytes()


class _Known(dict):
    """Pre-token to its ids as little-endian 32-bit words."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        return _words32(self.merges.encode_piece(piece.encode("utf-8", "surrogateescape")))

    def learn(self, *texts: list[str]) -> None:
        """Encodes together the pre-tokens that are new, but for long ones."""
        if len(self) > CACHE:
            for old in list(islice(self, CACHE // 3)):
                del self[old]
        new = [p for p in set().union(*texts) if p not in self and len(p) <= KEPT]
        self.update(zip(new, self.merges.encode_pieces([p.encode("utf-8", "surrogateescape") for p in new]), strict=True))

    def ids(self, text: list[str]) -> bytes:
        """The ids of a text's pre-tokens; if they are many, learns them by and by."""
        if len(text) <= PIECES:
            return b"".join(map(self.__getitem__, text))
        out = []
        for at in range(0, len(text), PIECES):
            part = text[at : at + PIECES]
            self.learn(part)
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)


def _held(key: str, make):
    """An object that stays with the worker process from task to task."""
    store = sys.__dict__.setdefault("_vellum_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def _encoder(told, name: str, pattern: str, keep: tuple[str, ...]):
    """Batches with __text to batches with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _held(name, lambda: _Known(Merges(told.value)))
        find = _held(name + "-pattern", lambda: regex.compile(pattern)).findall
        for batch in text_steps(batches, "__text", STEP):
            texts = [find(t) for t in texts_of(batch, "__text")]
            known.learn(*(t for t in texts if len(t) <= PIECES))
            out = [known.ids(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "ids"])

    return run


def _decoder(told, keep: tuple[str, ...]):
    """Batches with ids to batches with the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        token = {i: b for b, i in told.value.items()}
        for batch in text_steps(batches, "ids"):
            out = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return run


def _fields(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def _named(ranks: dict[bytes, int], pattern: str) -> str:
    return "bpe-" + hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds `ids` (binary: token ids as little-endian unsigned 32-bit words) to the kept
    columns; one output row per input row, in any partitioning, no shuffle.

    Each match of the pattern is encoded on its own, no special tokens are known, whole
    texts are taken however long. Null and empty texts have no ids. Bytes that are no UTF-8 are
    characters of no class to the pattern, and come back as they were. Other columns are
    ignored and cannot clash. Repeated rows are encoded each for itself; an empty table
    gives an empty result.
    """
    told = df.sparkSession.sparkContext.broadcast(ranks)  # fixed by the vocabulary file, not by the data
    run = _encoder(told, _named(ranks, pattern), pattern, keep)
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(tidy(run), f"{_fields(df, keep)}, ids binary")


def decode(df: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """Adds `decoded` (binary: the tokens' bytes in order) to rows with `ids` as encode()
    makes them. Null ids decode to no bytes; an id outside the vocabulary is an error."""
    told = df.sparkSession.sparkContext.broadcast(ranks)
    run = _decoder(told, keep)
    return df.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(tidy(run), f"{_fields(df, keep)}, decoded binary")


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() and then decode() of its ids, in one worker: the kept columns, ids, decoded."""
    told = df.sparkSession.sparkContext.broadcast(ranks)
    there, back = _encoder(told, _named(ranks, pattern), pattern, keep), _decoder(told, (*keep, "ids"))
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(tidy(lambda batches: back(there(batches))), f"{_fields(df, keep)}, ids binary, decoded binary")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text of `documents` and decodes the ids: doc_id, n_tokens,
    ids_sha256, decoded_sha256."""
    path, pattern = default_vocabulary()
    coded = round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), load_ranks(path), pattern)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
