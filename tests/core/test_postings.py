"""The inverted index beside the scan."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import postings, search


def rows_of(df):
    return [(r.id, round(r.score, 9)) for r in df.orderBy(F.col("score").desc(), "id").collect()]


def scan(docs, terms, n):
    return [(r.id, round(r.score, 9)) for r in search.top(search.bm25(docs, terms), n).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "that", "que", "straße", "x_1", "42"]
    weights = [1, 2, 5, 60, 40, 3, 2, 1]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 90)))) for i in range(1500)]
    rows += [(2000 + i, "that que") for i in range(60)] + [(3000, None), (3001, ""), (3002, "That, QUE; that-que!")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "bits"), [(128, 16), (4, 5), (1, 3)])
def test_search_is_the_scan(spark, texts, monkeypatch, block, bits):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SPAN_BITS", bits)
    monkeypatch.setattr(postings, "PARTITION", 3000)
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    index = postings.Index.build(docs)
    assert index.buckets > 1 and index.n == len(texts) == index.retold
    for terms, n in ((["that", "que"], 70), (["alpha", "beta", "straße"], 10), (["x_1", "nowhere", "que", "que"], 1)):
        assert rows_of(index.search(terms, n)) == scan(docs, terms, n), (terms, n)
    assert index.search(["nowhere"], 5).count() == 0 and index.search([], 5).count() == 0
    index.search(["alpha", "that"], 2).collect()
    if block < 128:  # the maxima spare most of the postings
        assert index.report.decoded < index.report.blocks / 2


def test_refresh_counts_only_what_changed(spark, texts):
    docs = spark.createDataFrame(texts, "id long, text string")
    index = postings.Index.build(docs)
    assert not index.refresh(docs.repartition(5)) and index.retold == len(texts)
    changed = dict(texts)
    for i in list(changed)[:7]:
        changed[i] = "alpha alpha anew"
    for i in list(changed)[20:25]:
        del changed[i]
    changed[9999] = "alpha beta"
    after = spark.createDataFrame(list(changed.items()), "id long, text string")
    assert index.refresh(after) and index.retold == 8
    assert rows_of(index.search(["anew", "beta", "that"], 12)) == scan(after, ["anew", "beta", "that"], 12)


def test_empty(spark):
    docs = spark.createDataFrame([], "id long, text string")
    index = postings.Index.build(docs)
    assert index.search(["a"], 3).count() == 0
    assert index.refresh(spark.createDataFrame([(1, "a b")], "id long, text string"))
    assert [r.id for r in index.search(["a"], 3).collect()] == [1]


def test_many_queries_at_once(spark, texts, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "SPAN_BITS", 6)
    docs = spark.createDataFrame(texts, "id long, text string")
    asked = {"a": ["that", "que"], "b": ["nowhere"], "c": ["alpha", "beta"], "d": []}
    found = postings.Index.build(docs).search_many(asked, 6)
    for q in ("a", "c"):
        assert rows_of(found.filter(F.col("query") == q)) == scan(docs, asked[q], 6)
    assert found.filter("query in ('b', 'd')").count() == 0


def test_reranking_is_better_than_fusion(spark):
    """On passages that were held out: the first document that holds the passage stands higher than by fused ranks."""
    from vellum.operators import rerank
    from vellum.operators.staging import staged
    from vellum.plans.text_queries import passages

    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    asked, relevant = passages(spark, d)
    relevant = staged(relevant, "relevant")
    rows = staged(rerank.candidates(postings.opened(f"documents of {d}", docs), docs, asked), "candidates")
    held_out = F.crc32("query") % 3 == 1
    model = rerank.fit(rows.filter(~held_out), relevant)
    mean = lambda ranked: rerank.reciprocal(ranked.filter(held_out), relevant.filter(held_out)).agg(F.avg("rr")).first()[0]
    from pyspark.sql import Window

    by = lambda *c: F.row_number().over(Window.partitionBy("query").orderBy(*c, "id"))
    counts = rows.withColumn("other", by((F.col("coverage") + 5 * F.col("phrase")).desc()))
    fused = counts.withColumn("rank", by((1 / (60 + F.col("rank")) + 1 / (60 + F.col("other"))).desc())).select("query", "id", "rank")
    got = mean(model.ranked(rows, 10)), mean(fused.filter("rank <= 10")), mean(rows.filter("rank <= 10").select("query", "id", "rank"))
    print("re-ranked, fused, BM25", got)
    assert got[0] > got[1] and got[0] > got[2]
    assert rerank.fit(rows.limit(0), relevant) is None


def test_reranking_learns_from_every_query(spark):
    """More queries than a sample of 2000 would hold: the moments are those of all candidates, and the gradient over all queries is 0."""
    import numpy as np

    from vellum.operators import rerank

    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 3, len(rerank.FEATURES)))
    x[:, :, 3] = 1.0  # a feature that never differs
    good = (x[:, :, 0] + 0.5 * x[:, :, 1] + rng.normal(size=(2600, 3))).argmax(axis=1)
    rows = [(f"q{q}", i, *x[q, i].tolist()) for q in range(2600) for i in range(3)]
    rows = spark.createDataFrame(rows, "query string, id int, " + ", ".join(f"{c} double" for c in rerank.FEATURES))
    alone = spark.createDataFrame([("lonely", 7, *[1e6] * len(rerank.FEATURES))], rows.schema)  # teaches nothing
    relevant = spark.createDataFrame([(f"q{q}", int(i)) for q, i in enumerate(good)], "query string, id int")
    model = rerank.fit(rows.unionByName(alone), relevant)
    flat = x.reshape(-1, len(rerank.FEATURES))
    assert np.allclose(model.mean, flat.mean(axis=0)) and np.allclose(np.delete(model.scale, 3), np.delete(flat.std(axis=0), 3))
    z, w = (x - np.array(model.mean)) / np.array(model.scale), np.array(model.weights)
    p = np.exp(z @ w)
    p /= p.sum(axis=1, keepdims=True)
    slope = np.einsum("qi,qik->k", p, z) - z[np.arange(2600), good].sum(axis=0)
    assert np.abs(slope / 2600 + 1e-3 * w).max() < 1e-7
    assert w[0] > w[1] > 0


def test_reranking_query_learns_from_all_passages(spark, monkeypatch):
    from vellum.operators import rerank
    from vellum.plans.text_queries import QUERIES

    seen = []
    monkeypatch.setattr(rerank, "fit", lambda rows, relevant: seen.append(rows))
    out = QUERIES["rerank_passages"](spark, "/root/testdata/sf0.001")
    learnt, ranked = ({r["query"] for r in df.select("query").distinct().collect()} for df in (seen[0], out))
    assert learnt == ranked and len(ranked) > 2
