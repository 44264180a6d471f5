"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan distance of
two such vectors never exceeds the fingerprints' Hamming distance, so the pairs within
distance 4 there hold every pair within 4 bits. The range join runs over grids: with the
segments dealt into g groups, a pair within Manhattan distance 4 has equal counts in g - 4
groups at least, so one of the projections onto g - 4 groups puts it into one cell of width
one. More groups make more grids with smaller cells; g follows from the number of
fingerprints, and any g finds the same pairs. The counts are kept in thermometer code (00, 01, 11): the Manhattan distance is the
number of differing code bits. Pairs of a cell that pass it are verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import HEAVY, KEY_ROWS, join_many, parts, staged, table, text_steps, tidy
from .components import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, SEED, BITS = 4, 42, 4
#: Rows of a grid cell that one task compares with each other; larger cells are cut into
#: tiles of about so many rows, and every two tiles meet.
TILE = 2048
#: Shingles of one text that are held at a time.
STEP = 1 << 18

LOW = 0x5555555555555555


def masks(groups: int) -> list[int]:
    """The bits of every choice of all but 4 of the groups of segments."""
    bits = [sum(3 << 2 * s for s in range(32) if s % groups == g) for g in range(groups)]
    return [sum(bits[g] for g in own) for own in combinations(range(groups), groups - BITS)]


def groups_for(n: int) -> int:
    """The number of groups at which n fingerprints cost least: each grid sends every
    fingerprint once (as much work as about 20 comparisons), and compares those of one cell.
    A segment of random fingerprints has equal counts in 3 of 8 pairs."""

    def cost(groups: int) -> float:
        grids = comb(groups, BITS)
        return grids * (20 + n / 2 * (3 / 8) ** (32 * (groups - BITS) / groups))

    return min(range(6, 13), key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned. No words: zero."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    run = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    ends = ends[shingle - 1 :]
    n, sums = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = b"".join([digest(run[s:e], seed) for s, e in zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per input row, no shuffle.

    Null and empty texts, and those without words, have fingerprint zero. Whole texts are
    taken. Other columns are ignored and cannot clash.
    """
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            fps = [_signed(fingerprint(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return src.mapInArrow(tidy(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def thermometer(x: np.ndarray) -> np.ndarray:
    """The two-bit segments' bit counts, in thermometer code."""
    low, high = x & np.uint64(LOW), (x >> np.uint64(1)) & np.uint64(LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def _thermometer(x: Column) -> Column:
    low = x.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _links(bits: int):
    """Links of a sorted run of (cell, tile) groups, as edges from each linked fingerprint
    to the least of those it reaches inside the run."""

    def found(fp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, us, vs = thermometer(fp), [], []
        at, d = np.arange(len(fp)), 0
        while len(at):
            d += 1
            at = at[at + d < len(fp)]
            at = at[key[at] == key[at + d]]
            # the Manhattan distance of the embeddings first, then the fingerprints
            near = at[np.bitwise_count(code[at] ^ code[at + d]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= bits]
            if len(near):
                us.append(near)
                vs.append(near + d)
        if not us:
            return fp[:0], fp[:0]
        kinds, no = np.unique(fp.view(np.int64), return_inverse=True)
        u, v = no[np.concatenate(us)], no[np.concatenate(vs)]
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        u, v = pairs[:, 0], pairs[:, 1]
        root = np.arange(len(kinds))
        while True:
            was = root.copy()
            np.minimum.at(root, u, root[v])
            np.minimum.at(root, v, root[u])
            root = root[root]
            if np.array_equal(root, was):
                break
        own = np.flatnonzero(root != np.arange(len(kinds)))
        return kinds[own], kinds[root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, keys = [], []

        def out(fp, key):
            u, v = found(fp, key)
            return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            fps.append(fp)
            keys.append(key)
            if not len(key) or keys[0][0] == key[-1] and sum(map(len, keys)) < 8 * TILE:
                continue
            fp, key = np.concatenate(fps), np.concatenate(keys)
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if cut:
                yield out(fp[:cut], key[:cut])
                fp, key = fp[cut:], key[cut:]
            fps, keys = [fp], [key]
        if fps:
            yield out(np.concatenate(fps), np.concatenate(keys))

    return run


def links(fps: DataFrame, bits: int = BITS, tile: int = TILE, groups: int | None = None, heavy: int | None = None) -> DataFrame:
    """Edges (u, v) that connect every two distinct fingerprints at most `bits` <= 4 bits
    apart, directly or through others. fps: distinct values in a column fp. groups: of segments,
    6 or more; by default as their number asks. heavy: rows from which on a cell is not joined by hash."""
    if not 0 <= bits <= BITS:
        raise ValueError("the grids hold pairs of up to 4 differing bits")
    spark = fps.sparkSession
    code = _thermometer(F.col("fp"))
    chosen = masks(groups or groups_for(fps.count()))
    cells = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), code.bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(chosen)])).alias("at"))
    cells = cells.select("fp", "at.grid", "at.cell")
    # cells too large for one task are cut into tiles
    crowd = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    crowd = staged(crowd.select("grid", "cell", "n", F.ceil(F.col("n") / tile).cast("int").alias("nt")), "simhash-crowds")
    at = ["grid", "cell"]
    share = max(heavy or KEY_ROWS, (crowd.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    most, rest = crowd.filter(F.col("n") > share).drop("n"), crowd.filter(F.col("n") <= share).drop("n")
    if most.isEmpty():
        dealt = cells.join(rest, at, "left")
    else:  # fewer than HEAVY cells: by broadcast, so that none gathers in a task
        told = F.broadcast(most)
        dealt = cells.join(told, at, "left_anti").join(rest, at, "left").unionByName(cells.join(told, at))
    mine = F.pmod(F.xxhash64("fp"), F.col("nt")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("nt") - 1), lambda t: F.struct(F.least(t, mine).alias("s"), F.greatest(t, mine).alias("t")))
    dealt = dealt.withColumn("tiles", F.explode(F.when(F.col("nt").isNull(), F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("t")))).otherwise(meets)))
    dealt = dealt.select(F.xxhash64("grid", "cell", "tiles.s", "tiles.t").alias("key"), "fp")
    met = dealt.repartition(parts(spark), "key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(tidy(_links(bits)), "u long, v long")


def near_duplicates(df: DataFrame, bits: int = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most `bits`
    differing bits. One row per input row.

    Texts without words share fingerprint zero and are linked by it like others. A null
    doc_id keeps its row; it never names a component unless all ids in it are null, then
    the component is null. Repeated rows and equal fingerprints are one class, compared
    once. An empty table gives an empty result.
    """
    printed = staged(fingerprints(df, doc_id, text), "simhash-prints")
    kinds = staged(printed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-kinds")
    joined = staged(components(links(kinds.select("fp"), bits)), "simhash-joined")
    named = joined.join(kinds, joined["node"] == kinds["fp"]).select("node", "root", "rep")
    least = staged(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c")), "simhash-least")
    named = join_many(staged(named, "simhash-members"), least, ["root"], "c").select(F.col("node").alias("fp"), "component_id")
    classes = staged(kinds.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id")), "simhash-classes")
    return join_many(printed, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of `documents`: doc_id, fingerprint, component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
