"""The inverted file beside brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import vectors


def brute(rows, asked, n):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in good.items()}
    out = {}
    for q, x in asked:
        x = np.array(x, float) / np.sqrt((np.array(x, float) ** 2).sum())
        s = sorted(((-round(float((u * x).sum()), 10), i) for i, u in unit.items()))[:n]
        out[q] = [(i, -c) for c, i in s]
    return out


def answer(df):
    out = {}
    for r in df.orderBy("query", F.round("score", 10).desc(), "id").collect():
        out.setdefault(r.query, []).append((r.id, round(r.score, 10)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(12, size=900)] + rng.normal(scale=0.1, size=(900, 16))
    out = [(int(i), v.tolist()) for i, v in enumerate(x)]
    out += [(2000 + i, out[5][1]) for i in range(40)]  # one vector many times
    return out + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, []), (5004, [1.0, None] + [1.0] * 14), (5005, [float("inf")] + [0.0] * 15)]


@pytest.mark.parametrize("tile", [16_384, 20])
def test_exact(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "QUERIES", tile)
    index = vectors.VectorIndex.build(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), cells=15)
    assert index.count.sum() == 940
    asked = [(f"q{i}", v) for i, v in rows[:900:37]] + [("far", [-1.0] * 16)]
    q = spark.createDataFrame([*asked, ("none", None), ("zero", [0.0] * 16)], "query string, q array<double>")
    assert answer(index.search(q, 10, probes=2)) == brute(rows, asked, 10)
    if tile > 100:
        assert answer(index.search(q.limit(3), 2000)) == brute(rows, asked[:3], 2000)
        found = index.search(q, 10, probes=4, exact=False)
        want = brute(rows, asked, 10)
        sure = {r.query for r in found.filter("certain").collect()}
        got = answer(found)
        assert sure and all(got[s] == want[s] for s in sure)
        exact = spark.createDataFrame([(k, i) for k, v in want.items() for i, _ in v], "query string, id long")
        assert vectors.recall(found, exact) >= 0.9


def test_recall_over_all_queries(spark):
    """Every twentieth row of the table against all rows, without going on to further cells."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = vectors.VectorIndex.build(v)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    got = vectors.recall(index.search(q, 10, exact=False), index.search(q, 10))
    print("recall", got)
    assert got >= 0.9


def test_empty(spark):
    none = spark.createDataFrame([], "id long, v array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query long, q array<float>")
    assert vectors.VectorIndex.build(none).search(q, 5).count() == 0
    index = vectors.VectorIndex.build(spark.createDataFrame([(1, [2.0])], "id long, v array<float>"))
    assert [(r.id, r.score) for r in index.search(q, 5).collect()] == [(1, 1.0)] and index.search(q.limit(0), 5).count() == 0
