"""SimHash against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash

from vellum.llm import simhash
from vellum.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, linked):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("tile", "groups", "heavy"), [(16, None, None), (2048, 6, None), (16, 8, None), (16, None, 20)])
def test_links_lose_nothing(spark, tile, groups, heavy):
    rng = random.Random(5)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.choice([0, 1, 6])):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.5 else x
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 20)}
    signed = sorted(simhash._signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, tile=tile, groups=groups, heavy=heavy)).collect()}
    linked = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    want = roots(signed, linked)
    assert {x: got.get(x, x) for x in signed} == want


def test_thermometer_is_a_lower_bound():
    x = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    y = x ^ (np.uint64(1) << np.random.default_rng(2).integers(0, 64, 2000).astype(np.uint64))
    assert (np.bitwise_count(simhash.thermometer(x) ^ simhash.thermometer(y)) <= np.bitwise_count(x ^ y)).all()


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", "one two", "ONE TWO", "é É Ab\tcd\x0bef", base, base.upper(), base + " tail", "one two", " \n", "w " * 5000]
    rows = [(i * 3 % 11, t, "x") for i, t in enumerate(texts)] + [(None, "one two", "x"), (None, "alone", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [(i, plain(t)) for i, t, _ in rows]
    values = {p for _, p in prints}
    root = roots(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted((str(i), simhash._signed(p), str(least.get(root[p]))) for i, p in prints)
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_follow_the_number_of_fingerprints():
    assert [simhash.groups_for(n) for n in (0, 10**5, 10**7, 10**8)] == [6, 6, 7, 8]
    for g in (6, 7, 8, 10):
        assert len(simhash.masks(g)) == len(set(simhash.masks(g))) and all(m.bit_count() >= 2 * (32 * (g - 4) // g - g) for m in simhash.masks(g))
