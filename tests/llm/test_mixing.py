"""Mixing against a water-filling loop and a word count."""

import re
from collections import defaultdict

import pytest

from vellum.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_words string, epoch int"


def level_targets(sizes, most=3):
    """Targets by repeated resharing, as the contract words it."""
    keys = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(keys)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        open_w = sum(weight[k] for k in keys if k not in capped)
        got = {k: most * sizes[k] if k in capped else rest * weight[k] / open_w for k in keys}
        over = {k for k in keys if k not in capped and got[k] > most * sizes[k] + 1e-9}
        if not over:
            return got
        capped |= over


@pytest.mark.parametrize("block", [7, 64])
def test_targets_and_taken(spark, block):
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else (None if i % 41 == 0 else f"s{i % 5}")
        rows.append((i, " ".join(["w"] * (i % 23)), source, "clash", 1))
    rows += [(5, "a b c", "s1", "x", 2)] * 3 + [(None, "tiny doc", "tiny", None, None), (900, None, "none", None, None), (901, "", "s1", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.taken(mixing.mix(df, block_words=block)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    want, got = level_targets(sizes), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        got[r.source] += r.taken
    for s in sizes:
        assert abs(got[s] - want[s]) <= 1
    again = mixing.taken(mixing.mix(df, block_words=block)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_schedule_is_the_golden_ratio_one(spark):
    """Slots against a plain loop over the golden-ratio points; blocks against a plain cut of the stream."""
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3], "", 0) for i in range(300)] + [(7, "same row", "a", "", 0)] * 50
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = mixing.mix(df, block_words=20).filter("slot is not null").collect()
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(t.split())
    words = {s: int(t + 1e-6) for s, t in level_targets(sizes).items()}
    total, lo, ranges = sum(words.values()), 0, {}
    for s in sorted(words):
        ranges[s] = (lo / total, (lo + words[s]) / total)
        lo += words[s]
    slots = -(-sum(sizes.values()) // 20)
    name = {}
    for i in range(slots):
        x = (i * mixing.GOLDEN + mixing.GOLDEN // 2) % mixing.UNIT / mixing.UNIT
        name[i] = next(s for s, (a, b) in ranges.items() if a <= x < b)
    assert {p.slot: p.source for p in pieces} == name
    for s in sizes:  # block k of a source fills its k-th slot; all blocks of a source differ by one word at most
        got = defaultdict(int)
        for p in pieces:
            if p.source == s:
                got[p.slot] += p.n_words
        mine = [i for i in range(slots) if name[i] == s]
        assert sorted(got) == mine and sum(got.values()) == words[s] and max(got.values()) - min(got.values()) <= 1


def test_ranges_of_sources(spark, monkeypatch):
    """Ranks and sums in two levels are those of one; copies in several tasks are those in one."""
    rows = [(i, "w " * (i % 7), f"s{i % 23}", "", 0) for i in range(200)] + [(3, "a b", None, "", 0)] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda: sorted(map(str, mixing.taken(mixing.mix(df, block_words=9)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    want = key()
    monkeypatch.setattr(mixing._targets, "__defaults__", (4,))
    assert key() == want
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    sums = lambda x: sorted((r.source or "", r["t"]) for r in x.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect())
    assert sums(mixing.taken(mixing.mix(df, block_words=9)))
    assert mixing.taken(mixing.mix(df, block_words=9)).count() == len(rows)


def test_pieces_tile_the_stream(spark):
    df = spark.createDataFrame([(i, "w " * 11, "ab"[i % 2], "", 0) for i in range(200)], SCHEMA)
    pieces = mixing.mix(df, block_words=50).filter("slot is not null").collect()
    slots = defaultdict(int)
    for p in pieces:
        slots[p.slot] += p.n_words
    assert max(slots.values()) - min(slots.values()) <= 2 + 50 // 5
    assert sorted(slots) == list(range(len(slots)))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
