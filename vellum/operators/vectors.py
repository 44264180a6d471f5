"""An inverted file over vectors, and nearest neighbours by cosine through it.

Cells are fitted by k-means on a sample of bounded size; every row is assigned to its nearest one, and a cell
knows its radius. A search reads the cells nearest to each query, scores their vectors in full precision, and
has a certificate: a unit vector in a cell is no nearer to the query than the centre's distance less the
radius, so where that bound lies below the n-th best score found, nothing better is left. Exact searches go
on to the cells without a certificate. Queries come as a table; queries and vectors meet by cell, and cells
that hold many of either are cut into tiles.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import kept_until_end, shared_dir, staged

#: Rows that k-means sees, cells at most (their centres are sent to every task), rounds of k-means.
SAMPLE, CELLS, ROUNDS = 20_000, 4096, 12
#: Share of the neighbours that the first cells should hold; rows and neighbours of the sample by which their number is set.
RECALL, ASKED, NEIGHBOURS = 0.95, 200, 10
#: Vectors, and queries, of a cell that meet in one task.
TILE, QUERIES = 16_384, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _fit(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres of k cells of the unit rows. Starts are spread by distance; an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(0)
    first = [int(rng.integers(len(x)))]
    far = ((x - x[first[0]]) ** 2).sum(axis=1)
    while len(first) < k:
        first.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[first[-1]]) ** 2).sum(axis=1))
    centres = x[first]
    for _ in range(rounds):
        near, d = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        lost = np.flatnonzero(n == 0)
        sums[lost], n[lost] = x[np.argsort(-d)[: len(lost)]], 1
        centres = sums / n[:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance."""
    near, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    size = (centres**2).sum(axis=1)
    step = max(1, most // max(1, len(centres)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        near[lo : lo + step] = np.argmin(size - 2 * (part @ centres.T), axis=1)
        d[lo : lo + step] = np.sqrt(((part - centres[near[lo : lo + step]]) ** 2).sum(axis=1))
    return near, d


def _probes(x: np.ndarray, centres: np.ndarray) -> int:
    """Of the cells in order of distance, how many hold RECALL of the neighbours of sampled rows."""
    asked = x[: min(ASKED, len(x))]
    n = min(NEIGHBOURS + 1, len(x))
    if not len(x) or n < 2:
        return 1
    near, _ = _nearest(x, centres)
    place = np.argsort(np.argsort((centres**2).sum(axis=1) - 2 * (asked @ centres.T), axis=1, kind="stable"), axis=1)
    found = np.argpartition(-(asked @ x.T), n - 1, axis=1)[:, :n]
    places = np.sort(np.take_along_axis(place, near[found], axis=1).ravel())
    return 1 + int(places[int(np.ceil(RECALL * len(places))) - 1])


class VectorIndex:
    """The cells of a table of vectors (id, v). id is unique and orders. Vectors that are null, empty, zero or hold null or
    non-finite components are in no cell and near to nothing; all others have as many components."""

    def __init__(self, spark: SparkSession, rows: DataFrame, centres: np.ndarray, probes: int, told: tuple[int, int]):
        self.spark, self.rows, self.centres, self.probes, self.print = spark, rows, centres, probes, told
        self.count, self.radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect():  # a row a cell
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"] + 1e-9

    @staticmethod
    def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, root: str | None = None) -> VectorIndex:
        """cells: about the square root of the rows where none are named. The table lies under root, else in the session's
        shared folder until the application ends."""
        spark = vectors.sparkSession
        told = _print(vectors)
        good = _usable(vectors)
        n = good.count()
        k = max(1, min(CELLS, cells or round(n**0.5), n))
        seen = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
        x = _unit(_matrix(seen.column("v"))) if len(seen) else np.zeros((0, 1))
        centres = _fit(x, min(k, len(x)), ROUNDS) if len(x) else np.zeros((0, 1))
        probes = _probes(x, centres)
        told_centres = spark.sparkContext.broadcast(centres)  # CELLS rows at most

        def assigned(batches):
            for b in batches:
                if b.num_rows:
                    near, d = _nearest(_unit(_matrix(b.column("v"))), told_centres.value)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(d)], names=["id", "v", "cell", "d"])

        kind = {f.name: f.dataType.simpleString() for f in good.schema}
        rows = good.mapInArrow(assigned, f"id {kind['id']}, v {kind['v']}, cell int, d double")
        path = f"{root or shared_dir(spark)}/cells-{uuid4().hex}"
        if root is None:
            kept_until_end(spark, path)
        # by cell inside the files, in small row groups: their statistics tell which hold a cell
        rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(1 + n // (k * TILE)))).sortWithinPartitions("cell").write.option("parquet.block.size", 4 << 20).parquet(path)
        return VectorIndex(spark, spark.read.schema(rows.schema).parquet(path), centres, probes, told)

    def search(self, queries: DataFrame, n: int, probes: int | None = None, exact: bool = True) -> DataFrame:
        """query, id, score, certain: the n nearest vectors of each query (query, q), ties to smaller ids. Without exact only `probes`
        cells (by default as many as the build found to hold most neighbours) are read for a query, and certain says whether the answer is the exact one all the same. query is unique; queries that
        are null, zero or hold null or non-finite components have no rows."""
        asked = staged(_usable(queries.select(F.col("query").alias("id"), F.col("q").alias("v"))).withColumnsRenamed({"id": "query", "v": "q"}), "vector-queries")
        probes = probes or self.probes
        place = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        top = lambda df: df.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n).drop("rank")
        parts = [top(self._best(self._routed(asked, probes, None), n))]
        floor = staged(parts[0].groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")), "vector-floors")
        # a query with fewer than n hits so far has no floor: every cell is left
        floor = asked.join(floor, "query", "left").select("query", "q", F.when(F.col("c") >= n, F.col("least")).alias("least"))
        rest = staged(self._routed(floor, probes, "least"), "vector-rest")
        if exact and not rest.isEmpty():
            parts.append(self._best(rest, n))
        best = top(reduce(DataFrame.unionByName, parts)) if len(parts) > 1 else parts[0]
        if exact:
            return best.withColumn("certain", F.lit(True))
        return best.join(rest.select("query").distinct().withColumn("open", F.lit(True)), "query", "left").select("query", "id", "score", F.col("open").isNull().alias("certain"))

    def _routed(self, queries: DataFrame, probes: int, least: str | None) -> DataFrame:
        """query, q, cell: the nearest cells of each query; with a column of scores to reach, the other cells that may reach them."""
        told = self.spark.sparkContext.broadcast((self.centres, self.radius, self.count))

        def run(batches):
            centres, radius, count = told.value
            for b in batches:
                if not b.num_rows or not len(centres):
                    continue
                q = _unit(_matrix(b.column("q")))
                d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * (q @ centres.T), 0))
                order = np.argsort(np.where(count > 0, d, np.inf), axis=1, kind="stable")
                near = np.zeros(d.shape, bool)
                np.put_along_axis(near, order[:, :probes], True, axis=1)
                near &= count > 0
                if least is not None:
                    gap = np.maximum(d - radius - 1e-7, 0)
                    floor = b.column(least).to_numpy(zero_copy_only=False)
                    # 1 - gap**2 / 2 bounds the cosine
                    near = ~near & (count > 0) & (np.isnan(floor)[:, None] | (1 - gap * gap / 2 >= np.nan_to_num(floor)[:, None] - 1e-9))
                at, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(at)), b.column("q").take(pa.array(at)), pa.array(cell.astype(np.int32))], names=["query", "q", "cell"])

        kind = {f.name: f.dataType.simpleString() for f in queries.schema}
        return queries.mapInArrow(run, f"query {kind['query']}, q {kind['q']}, cell int")

    def _best(self, routed: DataFrame, n: int) -> DataFrame:
        """query, id, score: from every tile of a cell the n best for each of its queries."""
        routed = staged(routed, "vector-routes")
        asks = {r["cell"]: r["c"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a cell
        if not asks:
            return staged(self.rows.select("id", F.lit(0.0).alias("score")).limit(0).join(routed.select("query").limit(0)).select("query", "id", "score"), "vector-hits")
        tiles = self.spark.createDataFrame([(c, 1 + int(self.count[c]) // TILE, 1 + k // QUERIES) for c, k in asks.items()], "cell int, nv int, nq int")
        tiles = F.broadcast(tiles)  # a row a cell
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c, n_: F.pmod(F.xxhash64(c), F.col(n_)).cast("int")
        q = routed.join(tiles, "cell").select("cell", every("nv").alias("i"), own("query", "nq").alias("j"), "query", "q")
        rows = self.rows.filter(F.col("cell").isin(list(asks))) if len(asks) < len(self.centres) else self.rows
        v = rows.join(tiles, "cell").select("cell", own("id", "nv").alias("i"), every("nq").alias("j"), "id", "v")
        kind = {"query": routed.schema["query"].dataType.simpleString(), "id": self.rows.schema["id"].dataType.simpleString()}
        by = ["cell", "i", "j"]
        return staged(q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(_tile(n), f"query {kind['query']}, id {kind['id']}, score double"), "vector-hits")


def _tile(n: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        none = pa.table({"query": asked.column("query").slice(0, 0), "id": held.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(asked) or not len(held):
            return none
        held = held.sort_by("id")
        q, v = _unit(_matrix(asked.column("q"))), _unit(_matrix(held.column("v")))
        ats, ids, scores = [], [], []
        step = max(1, (1 << 22) // len(v))
        for lo in range(0, len(q), step):
            rough = q[lo : lo + step] @ v.T
            floor = np.partition(rough, -n, axis=1)[:, -n] if n < len(v) else np.full(len(rough), -np.inf)
            for k, row in enumerate(rough):
                near = np.flatnonzero(row >= floor[k] - 1e-9)
                # summed row by row: equal vectors have equal scores, whatever stands beside them
                s = (v[near] * q[lo + k]).sum(axis=1)
                best = np.lexsort((near, -s))[:n]
                ats += [lo + k] * len(best)
                ids.append(near[best])
                scores.append(s[best])
        return pa.table({"query": asked.column("query").take(pa.array(ats, pa.int64())), "id": held.column("id").take(pa.array(np.concatenate(ids))), "score": pa.array(np.concatenate(scores))})

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """id, v of the vectors that have a direction."""
    x = F.transform("v", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.select("id", "v").filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _print(vectors: DataFrame) -> tuple[int, int]:
    n, s = vectors.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "v").cast("decimal(38,0)"))).first()
    return n, int(s or 0)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers (query, id) that were found."""
    met = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("one")), ["query", "id"], "left").agg(F.count("one").alias("met"), F.count(F.lit(1)).alias("n")).first()
    return met["met"] / met["n"] if met["n"] else 1.0


#: Indexes of this application, by name.
_open: dict[str, VectorIndex] = {}


def opened(name: str, vectors: DataFrame) -> VectorIndex:
    """The application's index of that name, built anew when the vectors are other ones."""
    index = _open.get(name)
    if index is None or index.spark is not vectors.sparkSession or index.print != _print(vectors):
        index = _open[name] = VectorIndex.build(vectors)
    return index
