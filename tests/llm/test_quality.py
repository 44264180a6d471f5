"""The field against enumeration, and held-out accuracy."""

import zlib
from itertools import product

import numpy as np
import pytest

from vellum.llm import quality


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    node, edge = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, log_z = quality.forward_backward(node, edge, quality.Chains.of(doc))
    want, z_sum, want_pairs = np.zeros(8), 0.0, np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z, hits, joint = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in product((0, 1), repeat=len(at)):
            p = np.exp(sum(node[i] * s for i, s in zip(at, y, strict=True)) + sum(edge[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += p
            hits += p * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                joint[a, b] += p
        want[at] = hits / z
        want_pairs += joint / z
        z_sum += np.log(z)
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and abs(log_z - z_sum) < 1e-9


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 1.0), (3, "\n\n\n", 1.0), (None, "x", 1.0), (4, "a fine line. " * 30_000, 0.0), (5, "x\n" * 5000, 0.0), (4, "tie", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(None, 1, 0), (1, None, 0), (2, 9, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), None).count() == 0


def plain_score(model, text):
    """The score of one text by itself: features by loops over characters' bytes, the chain by enumeration-free recursion."""
    import re

    lines = [x[i : i + quality.LONGEST] for x in text.encode().split(b"\n") for i in range(0, max(len(x), 1), quality.LONGEST)]
    feats, seen = [], set()
    for line in [x for x in lines if x]:
        n = len(line)
        count = lambda p: len(re.findall(p, line, re.S))  # noqa: B023, E731
        upper, lower, digit, space, other, stop, bang, odd = (count(p) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[ \t\r\x0b\x0c]", rb"[\xc0-\xff]", rb"[.,;:?'\"()-]", rb"!", rb"[#$%&*+/<=>@\[\\\]^_`{|}~]"))
        runs = sum(a == b and quality.MARKS[a] for a, b in zip(line, line[1:], strict=False))
        letters, words, run = max(upper + lower + other, 1), space + 1, line.split()
        same = sum(a == b for a, b in zip(run, run[1:], strict=False)) / len(run) if len(run) > 1 else 0
        feats.append([
            np.log1p(n) / 5, upper / letters, digit / n, space / n, other / n, stop / n, bang / n, odd / n, runs / n, min((upper + lower + other) / words, 20) / 10,
            line in seen, line[-1:] in (b".", b"!", b"?"), odd > 0.3 * words, upper > 0.6 * letters, same, same > 0.3, 1 - len(set(run)) / len(run) if len(run) > 1 else 0,
        ])
        seen.add(line)
    if not feats:
        return model.score(0.0)
    none = [0.0] * quality.FEATURES
    wide = [[*x, *(feats[i - 1] if i else none), *(feats[i + 1] if i + 1 < len(feats) else none), i > 0, i + 1 < len(feats)] for i, x in enumerate(feats)]
    node = ((np.array(wide, float) - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
    forward, back = [np.array([0, node[0]])], [np.zeros(2)]
    for v in node[1:]:
        forward.append(np.logaddexp(*(forward[-1][:, None] + model.edge)) + np.array([0, v]))
    for v in node[:0:-1]:
        back.insert(0, np.logaddexp(*(model.edge + np.array([0, v]) + back[0]).T))
    both = np.array(forward) + np.array(back)
    good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    size = np.array([len(x) for x in lines if x])
    return model.score((good * size).sum() / size.sum())


def test_scores_are_those_of_each_text_alone(spark, monkeypatch):
    """The whole operator against the plain version, under several partitionings; long lines are cut from their own start."""
    monkeypatch.setattr(quality, "LONGEST", 700)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "one long line " * 20_000), (-2, "é" * 3001 + "\nshort"), (-3, ""), (-4, None)], "doc_id long, text string"))
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id: plain_score(model, r.text or "") for r in docs.collect()}
    first = None
    for n in (1, 5, 16):
        got = {r.doc_id: r.score for r in quality.score(docs.repartition(n), model).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
        assert first is None or got == first
        first = got


def test_a_mark_at_the_edge_of_a_text_is_its_own(spark):
    """A text that begins with the mark with which its neighbour ends scores as it does alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    marks = [chr(i) for i in range(128) if quality.MARKS[i]]
    assert marks
    texts = [x for m in marks for x in (f"what is this{m}", f"{m}{m} short line", f"{m} other\n{m}{m}")]
    one = lambda rows: {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    together = one(list(enumerate(texts)))
    backwards = one(list(enumerate(texts))[::-1])
    assert together == backwards and all(abs(together[i] - plain_score(model, t)) < 1e-4 for i, t in enumerate(texts))
    assert all(one([(i, t)])[i] == together[i] for i, t in list(enumerate(texts))[:6])


def test_ids_that_are_no_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("concat('d', doc_id) as doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("concat('d', doc_id) as doc_id", "quality", "toxic")
    assert quality.train(docs, labels) is not None


def test_repeated_training_ids(spark):
    """Of several texts of an id always the same one is learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.selectExpr("doc_id", "concat('!!! ', text, ' 000') as text"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = (quality.train(more.repartition(n), labels) for n in (1, 7))
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out(spark, sf):
    got = {r.doc_id: r for r in quality.op1_line_crf(spark, f"/root/testdata/{sf}").collect()}
    labels = [r for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in labels)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.97
