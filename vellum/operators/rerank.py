"""Re-ranking of search hits by a listwise model.

Candidates come from the inverted index. Their features are column expressions over the query's terms and the
document's text; a linear model of them is fitted so that the softmax of the scores of a query's candidates gives
the relevant ones most, and scoring is again one expression, without any model outside. All queries with a relevant
candidate are learnt from; they stay with the tasks, and the driver gets sums of the size of the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from .postings import Index
from .staging import release, staged

#: Candidates of a query.
CANDIDATES = 30
FEATURES = ("bm25", "place", "coverage", "phrase", "pairs", "title", "length", "early")


def candidates(index: Index, docs: DataFrame, asked: Mapping[str, Sequence[str]], n: int = CANDIDATES) -> DataFrame:
    """query, id, rank (by BM25), and the features of the n best documents (docs: id, text) of each named query."""
    found = index.search_many(asked, n)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id")))
    terms = docs.sparkSession.createDataFrame([(q, list(t)) for q, t in asked.items()], "query string, terms array<string>")
    met = docs.join(F.broadcast(found.join(F.broadcast(terms), "query")), "id")  # n rows for each named query
    low, terms = F.lower("text"), F.col("terms")
    phrase = F.array_join(terms, " ")
    share = lambda found_, of: F.when(F.size(of) > 0, F.size(found_) / F.size(of)).otherwise(0.0)
    pairs = F.transform(F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), terms[i + 1]))
    hit = F.nullif(F.instr(low, terms[0]), F.lit(0))
    return met.select(
        "query", "id", "rank", F.col("score").alias("bm25"), (1 / (60 + F.col("rank"))).alias("place"),
        share(F.filter(terms, lambda t: F.contains(low, t)), terms).alias("coverage"), F.log1p(occurrences(low, phrase).cast("double")).alias("phrase"),
        share(F.filter(pairs, lambda p: F.contains(low, p)), pairs).alias("pairs"), F.contains(F.substring(low, 1, 80), phrase).cast("double").alias("title"),
        F.log1p(F.length("text").cast("double")).alias("length"), (1 / (1 + F.coalesce(hit.cast("double"), F.lit(1e6)))).alias("early"),
    )


@dataclass(frozen=True)
class Reranker:
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def score(self) -> Column:
        """The model's score of a row of candidates()."""
        out = F.lit(0.0)
        for name, w, m, s in zip(FEATURES, self.weights, self.mean, self.scale, strict=True):
            out = out + F.lit(w / s) * (F.col(name) - F.lit(m))
        return out

    def ranked(self, rows: DataFrame, n: int) -> DataFrame:
        """query, id, rank: each query's n best candidates, ties to smaller ids."""
        place = F.row_number().over(Window.partitionBy("query").orderBy(self.score().desc(), "id"))
        return rows.withColumn("rank", place).filter(F.col("rank") <= n).select("query", "id", "rank")


def fit(rows: DataFrame, relevant: DataFrame, decay: float = 1e-3, most_rounds: int = 100) -> Reranker | None:
    """A model of candidates (rows) whose relevant documents are known (query, id), learnt from all queries; one without a
    relevant candidate teaches nothing. None if there is nothing to learn from.

    The loss, the mean of the queries' cross entropies and decay / 2 times the squared weights, is convex and has one
    least point, which Newton steps reach, halved where they would not lower it. A step is a pass over all queries."""
    marked = rows.join(relevant.select("query", "id", F.lit(1.0).alias("good")).distinct(), ["query", "id"], "left").fillna(0.0, ["good"])
    each = F.sort_array(F.collect_list(F.struct("id", "good", *[F.col(c).cast("double").alias(c) for c in FEATURES])))  # a query's candidates
    every = marked.groupBy("query").agg(each.alias("c")).filter(F.exists("c", lambda c: c["good"] > 0))
    held = staged(every.select(F.col("c.good").alias("good"), F.flatten(F.array(*[F.col(f"c.{c}") for c in FEATURES])).alias("x")), "rerank-queries")
    try:
        size, mean, scale = _moments(held)
        if not size:
            return None
        total = lambda w: _total(held, w, mean, scale, decay)
        w = np.zeros(len(FEATURES))
        loss, slope, bend = total(w)
        for _ in range(most_rounds):
            step = np.linalg.solve(bend, slope)
            if slope @ step < 1e-16:  # twice what is still to be gained
                break
            part = 1.0
            while (new := total(w - part * step))[0] > loss - 1e-4 * part * (slope @ step) and part > 1e-6:
                part /= 2
            if new[0] >= loss:  # as low as doubles tell
                break
            w, (loss, slope, bend) = w - part * step, new
        return Reranker(tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))
    finally:
        release(held)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query what is good (n) and the features (n rows)."""
    for batch in batches:
        ends, good, x = batch.column("good").offsets.to_numpy(), batch.column("good").values.to_numpy(), batch.column("x").values.to_numpy()
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield good[i:j], x[i * len(FEATURES) : j * len(FEATURES)].reshape(len(FEATURES), j - i).T


def _sums(held: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all tasks of the vectors that `of` makes of a task's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([{"v": of(_queries(batches)).tolist()}])

    every = held.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in every.collect():  # a row for each place of the vector
        out[r["i"]] = r["v"]
    return out


def _moments(held: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many queries, and of each feature the mean and the deviation over all their candidates."""
    k = len(FEATURES)

    def first(queries) -> np.ndarray:
        out = np.zeros(2 + k)
        for good, x in queries:
            out += np.concatenate(([1.0, len(good)], x.sum(axis=0)))
        return out

    sums = _sums(held, first, 2 + k)
    mean = sums[2:] / max(sums[1], 1.0)

    def second(queries) -> np.ndarray:
        out = np.zeros(k)
        for _, x in queries:
            out += ((x - mean) ** 2).sum(axis=0)
        return out

    return int(sums[0]), mean, np.maximum(np.sqrt(_sums(held, second, k) / max(sums[1], 1.0)), 1e-9)


def _total(held: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss at w, its gradient and its second derivatives, over all queries."""
    k = len(FEATURES)

    def run(queries) -> np.ndarray:
        loss, slope, bend, n = 0.0, np.zeros(k), np.zeros((k, k)), 0
        for good, x in queries:
            x, y = (x - mean) / scale, good / good.sum()
            s = x @ w
            top = s.max()
            p = np.exp(s - top)
            z = p.sum()
            p /= z
            own = p @ x
            loss, n = loss + np.log(z) + top - y @ s, n + 1
            slope += own - y @ x
            bend += (x * p[:, None]).T @ x - np.outer(own, own)
        return np.concatenate(([n, loss], slope, bend.ravel()))

    sums = _sums(held, run, 2 + k + k * k)
    n = sums[0]
    return sums[1] / n + decay / 2 * float(w @ w), sums[2 : 2 + k] / n + decay * w, sums[2 + k :].reshape(k, k) / n + decay * np.eye(k)


def reciprocal(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """query, rr: the reciprocal rank of the first relevant document, 0 without one, for each query that has relevant documents."""
    hit = ranked.join(relevant.select("query", "id").distinct(), ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return relevant.select("query").distinct().join(hit, "query", "left").select("query", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))
