"""The filter's counts and the scores against plain counting."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import lm


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain(train, docs):
    uni, pair = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        pair.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    back = lm.restored()
    near = lambda c: back[lm.quantised(np.array([c]))[0]] if c else 0.0
    out = []
    for t in docs:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        s = 0.0
        for a, b in zip([None, *w], w, strict=False):
            p = (near(uni[b]) + 0.5) / (n + 0.5 * (v + 1))
            first = near(uni[a])
            s += math.log10((min(near(pair["<s>" if a is None else a, b]), first) + lm.SMOOTH * p) / (first + lm.SMOOTH))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, s))
    return out


@pytest.mark.parametrize(("portion", "step"), [(lm.PORTION, lm.STEP), (600, 64)])
def test_scores(spark, monkeypatch, portion, step):
    monkeypatch.setattr(lm, "STEP", step)
    texts = ["The cat sat on the mat", "the CAT sat", None, "", " \t\n", "É é\x0bÉ", "a" * 200 + " b", "tie tie", "tie tie", "dog " * 300] + [f"w{i % 7} w{i % 3} the" for i in range(40)]
    df = spark.createDataFrame([(i if i != 4 else None, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    train = [t for i, t in enumerate(texts) if i % 5]
    model = lm.build(spark.createDataFrame([(t,) for t in train], "text string"), bits=64, probes=8)
    got = lm.score(df, model, probes=8, portion=portion).collect()
    want = plain(train, texts)
    key = lambda r: (r[0], r[1], round(r[3], 6), round(r[4], 5))
    a = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for x, y in zip(a, sorted(want, key=key), strict=True):
        assert x[:3] == y[:3]
        assert np.allclose(x[3:], y[3:], atol=1e-6)


def test_empty_model(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.build(none)
    assert lm.score(none, model).count() == 0
    got = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs if not out(r.doc_id)], [r.text for r in docs]), strict=True))
    got = lm.op7_bloom_lm(spark, sf).collect()
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), *w[:3])
        assert abs(r.base_score - w[3]) < 1e-6 * abs(w[3]) + 1e-6
    held = [r for r in got if r.held_out]
    per = lambda f: sum(getattr(r, f) for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score")
    exact = sum(want[r.doc_id][4] for r in held) / sum(r.n_tokens for r in held)
    assert abs(per("score") - exact) < 0.05
