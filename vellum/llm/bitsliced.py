"""Exact top-k inner products over a bit-sliced index.

The index packs every block of rows into bitmaps: one for each bit of each quantised
attribute (an attribute's values are stored above their least one in the block). A query
adds the slices of its attributes, shifted by the set bits of its weights, in columns of
equal significance with carry-save adders, 64 rows to a machine word; a negative weight
adds the complement slices. The sums are bit slices again: the top rows are selected from
the most significant slice downward, and rows tied at the boundary are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._common import staged, table, tidy

#: Rows of an index block; queries of a chunk; chunks that one task takes with a block.
BLOCK_ROWS, CHUNK, CHUNKS = 1 << 15, 64, 8
#: Quantised components must lie below this; scores must fit a long. Both are checked.
RANGE = 1 << 61


class Block:
    """Bit slices of the rows of one block. values: (rows, dims) integers; ids ascend. keys
    tell rows of one id apart."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, values: np.ndarray):
        self.ids, self.keys, (self.n, self.dims) = ids, keys, values.shape
        self.words = -(-max(self.n, 1) // 64)
        self.least = values.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        up = values - self.least
        self.bits = [int(x).bit_length() for x in (up.max(axis=0) if self.n else [0] * self.dims)]
        planes = [self._pack((up[:, d] >> b) & 1) for d in range(self.dims) for b in range(self.bits[d])]
        plain = np.stack(planes) if planes else np.zeros((0, self.words), np.uint64)
        self.at = np.concatenate(([0], np.cumsum(self.bits))).astype(int)
        self.live = self._pack(np.ones(self.n, np.uint8))
        self.slices = np.concatenate([plain, ~plain & self.live])

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner products, least significant first, and the constant to add."""
        columns: list[list[int]] = []
        base, flip = 0, len(self.slices) // 2
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            base += q * int(self.least[d])
            first = int(self.at[d])
            if q < 0:
                base += q * ((1 << self.bits[d]) - 1)
                first, q = first + flip, -q
            shift = 0
            while q:
                if q & 1:
                    while len(columns) < shift + self.bits[d]:
                        columns.append([])
                    for b in range(self.bits[d]):
                        columns[shift + b].append(first + b)
                q >>= 1
                shift += 1
        out, carried = [], []
        w = 0
        while w < len(columns) or carried:
            rows = [self.slices[columns[w]]] if w < len(columns) and columns[w] else []
            x = np.concatenate(rows + carried) if rows or carried else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(x) >= 3:
                t = len(x) // 3
                a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                ab = a ^ b
                carried.append((a & b) | (c & ab))
                x = np.concatenate((ab ^ c, x[3 * t :]))
            if len(x) == 2:
                carried.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            w += 1
        return out, base

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows whose key is not `own`, best first."""
        sums, base = self.sums(query)
        tied = self.live.copy()
        for i in np.flatnonzero(self.keys == own).tolist():
            tied[i >> 6] &= ~np.uint64(1 << (i & 63))
        won = np.zeros(self.words, np.uint64)
        for plane in reversed(sums):
            ones = tied & plane
            n = int(np.bitwise_count(won).sum()) + int(np.bitwise_count(ones).sum())
            if n > k:
                tied = ones
            else:
                won |= ones
                tied &= ~plane
                if n == k:
                    break
        at = self._rows(won)
        if len(at) < k:  # rows equal in every slice: the smaller ids go first
            at = np.concatenate((at, self._rows(tied)[: k - len(at)]))
        # whole numbers of any size where the slices need it
        score = np.full(len(at), base, np.int64 if len(sums) < 62 and abs(base) < 1 << 62 else object)
        for w, plane in enumerate(sums):
            ones = ((plane[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            score += ones.astype(score.dtype) << w if score.dtype != object else np.array([int(x) << w for x in ones], object)
        if score.dtype == object and len(score):
            if max(map(abs, score)) >= 1 << 63:
                raise OverflowError("an inner product does not fit 64 bits")
            score = score.astype(np.int64)
        order = np.lexsort((self.ids[at], -score))
        return self.ids[at][order], score[order]

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(df: DataFrame, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, q (floor(scale * component) as longs), key (the row's own number): the rows whose
    id and vector are not null and whose components are all finite, repeated ones each for
    itself. A component of 2**61 or more, quantised, is an error. The table is staged."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    far = F.raise_error(F.lit("a component is too large for inner products of 64 bits")).cast("long")
    q = F.transform(v, lambda x: F.when(F.abs(scale * x.cast("double")) < float(RANGE), F.floor(scale * x.cast("double")).cast("long")).otherwise(far))
    out = df.filter(F.col(vec_id).isNotNull() & v.isNotNull() & whole).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))
    return staged(out.withColumn("key", F.monotonically_increasing_id()), "bitsliced-rows")


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def _packed(tab: pa.Table) -> pa.Table:
    """One row for a group of rows of one length: ids, keys and values as raw 64-bit words, by id."""
    ids, keys = (tab.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "key"))
    order = np.lexsort((keys, ids))
    x = _matrix(tab.column("q"))[order]
    return pa.table({
        "part": tab.column("part")[:1], "dims": tab.column("dims")[:1],
        "ids": pa.array([ids[order].tobytes()]), "keys": pa.array([keys[order].tobytes()]), "x": pa.array([x.tobytes()]),
    })


PACKED = "part int, dims int, ids binary, keys binary, x binary"


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, key, rank, vec_id, score: the k rows of largest integer inner product for
    each query row, ties to smaller ids, the query's own row left out. rows as quantised()
    makes them, queries some of these; key tells apart queries that share an id.

    Vectors are compared with vectors of their own length only. All rows are indexed and
    every query meets every block: exact, whatever the sizes. A score of a best row that does not
    fit a long is an error. Empty tables give no rows.
    """
    n, m = rows.count(), queries.count()
    nb, nc = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // CHUNK))
    pack = lambda df, p: df.select((F.pmod(F.xxhash64("key"), F.lit(p))).cast("int").alias("part"), F.size("q").alias("dims"), "vec_id", "q", "key").groupBy("part", "dims").applyInArrow(_packed, PACKED)
    salts = -(-nc // CHUNKS)
    blocks = pack(rows, nb).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    chunks = pack(queries, nc).select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("part"), "dims", (F.col("part") % salts).alias("salt"), F.col("ids").alias("qids"), F.col("keys").alias("qkeys"), F.col("x").alias("qx"))
    met = blocks.join(chunks, ["part", "dims", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: np.frombuffer(batch.column(c)[row].as_buffer(), np.int64)  # noqa: B023, E731
                which = (batch.column("part")[row].as_py(), batch.column("dims")[row].as_py())
                dims = which[1]
                if which != last:
                    ids = get("ids")
                    block, last = Block(ids, get("keys"), get("x").reshape(len(ids), dims)), which
                qids, qkeys = get("qids"), get("qkeys")
                out = [[], [], [], []]
                for i, h, q in zip(qids, qkeys, get("qx").reshape(len(qids), dims), strict=True):
                    ids, scores = block.top(q, k, int(h))
                    for to, x in zip(out, (np.full(len(ids), i), np.full(len(ids), h), ids, scores), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "key", "vec_id", "score"])

    best = met.select("part", "dims", "ids", "keys", "x", "qids", "qkeys", "qx").mapInArrow(tidy(run), "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "key", "rank", "vec_id", "score")


def op2_bitsliced_topk(spark: SparkSession, sf_dir: str, k: int = 20, every: int = 20) -> DataFrame:
    """The 20 rows of `embeddings` with the largest integer inner products, for every row
    whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    rows = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    found = top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
    return found.select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
with q as (
  select row_number() over () as key, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.key, a.vec_id as query_id, b.vec_id as vec_id,
         list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::bigint as score
  from q a join q b on a.key <> b.key and len(a.v) = len(b.v)
  where a.vec_id % 20 = 0
)
select query_id, rank, vec_id, score from (
  select query_id, vec_id, score,
         row_number() over (partition by key order by score desc, vec_id)::int as rank
  from s) where rank <= 20
"""
