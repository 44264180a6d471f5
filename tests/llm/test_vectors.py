"""Bit-sliced top-k and cosine near-duplicates against brute force."""

import math
import random

import numpy as np
import pytest

from vellum.llm import bitsliced, cosine

NAN, INF = float("nan"), float("inf")


def test_block_sums():
    rng = np.random.default_rng(4)
    for n, dims, span in ((1, 1, 2), (70, 5, 30), (300, 16, 4000)):
        x = rng.integers(-span, span, (n, dims))
        block = bitsliced.Block(np.arange(n) * 2, np.arange(n) * 2, x)
        for _ in range(5):
            q = rng.integers(-span, span, dims)
            score = x @ q
            for k in (1, 7, 500):
                ids, got = block.top(q, k, 4)
                want = sorted(((-s, i * 2) for i, s in enumerate(score.tolist()) if i != 2))[:k]
                assert list(zip((-got).tolist(), ids.tolist(), strict=True)) == want


def test_top_k(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 1.0]) for _ in range(6)]) for i in range(150)]
    rows += [(3, rows[3][1]), (40, rows[40][1]), (40, [x + 0.001 for x in rows[40][1]]), (200, None), (220, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (240, [NAN] * 6), (260, [INF] * 6), (None, rows[0][1]), (20, [9.0] * 6), (300, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    q = bitsliced.quantised(df)
    got = bitsliced.top_k(q, q.filter("vec_id % 20 = 0"), 20).collect()
    good = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (i, v) in enumerate(good):  # every row but the query's own, repeated ones too
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for no, (j, w) in enumerate(good) if no != at and len(w) == len(v))[:20]
            want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r.vec_id, r.score, r.rank) for r in got) == sorted(want)
    assert bitsliced.top_k(q.limit(0), q.limit(0), 20).count() == 0


def test_large_components(spark):
    """No value is clamped; what a long cannot hold is an error."""
    rows = [(0, [1.0, 0.0]), (1, [3e6, 0.0]), (2, [2e6, 1.0]), (3, [-4e6, 2.0]), (20, [3e7, -5e7])]
    frame = lambda rows: bitsliced.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = frame(rows)
    got = sorted((r.query_id, r.vec_id, r.score) for r in bitsliced.top_k(q, q.filter("vec_id % 20 = 0"), 20).collect())
    want = [(i, j, 4096 * int(v[0] * w[0] + v[1] * w[1])) for i, v in rows if i % 20 == 0 for j, w in rows if i != j]
    assert got == sorted(want)
    q = frame([(0, [3e9]), (1, [2e9])])
    with pytest.raises(Exception, match="does not fit"):
        bitsliced.top_k(q, q, 20).collect()
    with pytest.raises(Exception, match="too large"):
        frame([(0, [1e30])])


@pytest.mark.parametrize("tile", [8, 4096])
def test_cosine(spark, tile):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.1, 0.2])
        rows.append((1000 - i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    rows += [(1, rows[0][1], None), (2, None, 0), (3, [0.0] * 8, 0), (4, [NAN] * 8, 0), (5, [INF] * 8, 0), (6, [None] * 8, 0), (7, [], 0), (8, [1.0], 0), (9, [2.0], 0), (rows[5][0], rows[5][1], rows[5][2]), (10, [1e30] * 8, 0), (11, [1e-30] * 8, 0)]
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cosine.near_duplicates(df, tile=tile).collect())

    n = len(rows)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    count = [0] * n
    for i in range(n):
        for j in range(i):
            (_, v, y), (_, w, z) = rows[i], rows[j]
            if y is None or y != z or not v or not w or len(v) != len(w) or not all(x is not None and math.isfinite(x) for x in v + w):
                continue
            v, w = np.float32(v).astype(float), np.float32(w).astype(float)
            if v.any() and w.any() and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                count[i] += 1
                count[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(rows[i][0], least.get(find(i), 1 << 60))
    want = sorted((rows[i][0], count[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))
    assert got == want
    assert cosine.near_duplicates(df.limit(0)).count() == 0


def test_bound_is_never_too_tight():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(200, 16))
    b = a + rng.normal(size=a.shape) * 0.12
    b[:50] = a[:50] * 3
    want = {(i, j) for i in range(200) for j in range(200) if a[i] @ b[j] / np.sqrt((a[i] @ a[i]) * (b[j] @ b[j])) >= 0.98}
    got = {p for x, y in cosine.linked_pairs(a, b, 0.98) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == want
