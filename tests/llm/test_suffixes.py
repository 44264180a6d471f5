"""Suffix deduplication against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vellum.llm import _common, suffixes


def plain(texts, length):
    """(spans, kept) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append(([(int(a), int(b)) for a, b in edge.reshape(-1, 2)], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus(rng, n, length):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(length // 8, length))) for _ in range(6)]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[a : a + rng.randint(1, 3 * length)]
            parts += [p, " ".join(word() for _ in range(rng.randint(0, 20)))]
        texts.append("".join(parts))
    texts += [None, "", "x", "ab" * length, "a" * (3 * length), "a" * (length - 1), "a" * length, "a" * length, texts[0], texts[3], passages[0], passages[0][1:]]
    return texts


@pytest.mark.parametrize(("length", "crowd", "segment"), [(16, 400, 1 << 19), (40, 400, 300), (40, 2, 1 << 19), (24, 1, 1 << 19)])
def test_against_all_windows(spark, monkeypatch, length, crowd, segment):
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    if crowd < 10:
        monkeypatch.setattr(_common, "KEY_ROWS", 5)  # common keys go by broadcast
        monkeypatch.setattr(_common, "HEAVY", 1 << 40)
    texts = corpus(random.Random(length + crowd), 60, length)
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, tid string")
    got = suffixes.remove_repeats(df, length, crowd).collect()
    want = plain([(t or "").encode() for _, t, _ in rows], length)
    expect = sorted((str(i), len((t or "").encode()), str(s), k) for (i, t, _), (s, k) in zip(rows, want, strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, str([(x.start, x.end) for x in r.spans]), bytes(r.kept)) for r in got) == expect


def test_words_and_characters(spark):
    """Short repeats stay, and characters are never divided; genuine replacement characters stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line, passage = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(40))
    texts = [f"x{i}\ufffdé{line}é y{i}{chr(0xE0 + i)}{passage}{chr(0xE0 + i)}z{i}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffixes.remove_repeats(df, 40, least_words=30, whole_chars=True).collect()}
    assert got == {i: f"x{i}\ufffdé{line}é y{i}{chr(0xE0 + i)}z{i}" for i in range(3)}


def test_work_of_a_crowded_gram(spark):
    """One passage in many different surroundings: rows in proportion to its occurrences."""
    rng, made = random.Random(9), []
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(150)
    texts = [noise(120) + passage + noise(120) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    real = suffixes._uncrowded

    def counted(around, length, crowd):
        made.append(around.count())
        calm, solved = real(around, length, crowd)
        made.append(sum(x.count() for x in (*calm, *solved)))
        return calm, solved

    suffixes._uncrowded = counted
    try:
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, 4).collect()
    finally:
        suffixes._uncrowded = real
    want = plain([t.encode() for t in texts], 100)
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == [(i, k) for i, (_, k) in enumerate(want)]
    assert made[0] >= 200 and made[1] <= 8 * made[0]


def test_loser_tree():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for k in (1, 2, 3, 7, 40):
        runs = [suffixes.front_coded([(w, (i,)) for i, w in enumerate(words) if i % k == r]) for r in range(k)]
        out = list(suffixes.merged(runs))
        assert [s for _, s, _ in out] == sorted(words)
        assert sorted(p[0] for *_, p in out) == list(range(300))
        for (_, a, _), (n, b, _) in zip(out, out[1:], strict=False):
            assert n == suffixes.shared_prefix(a, b)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain([(r.text or "").encode() for r in docs], 400)
    got = {r.doc_id: r for r in suffixes.op3_suffix_dedup(spark, sf).collect()}
    for r, (spans, kept) in zip(docs, want, strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len(r.text.encode()), len(r.text.encode()) - len(kept), len(spans))
        assert g.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_query_at_400_bytes(spark, tmp_path):
    """Passages of over 50 words in three documents each: of 400 bytes all copies go, of 399 none; n_bytes is the input's."""
    rng = random.Random(7)

    def passage(size):
        words = "".join(rng.choice("bcdfghjk") * rng.randint(1, 3) + "aeiou"[i % 5] + " " for i in range(size))
        return words[: size - 1] + "z"

    short, full = passage(399), passage(400)
    assert min(len(short.split()), len(full.split())) > 50
    texts = [f"{a}{p}{b}" for p in (short, full) for a, b in ("AD", "BE", "CF")] + ["left alone, é", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffixes.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    kept = [t or "" for t in texts]
    kept[3:6] = ["AD", "BE", "CF"]
    assert [got[i].text for i in range(len(texts))] == kept
    assert [(got[i].n_bytes, got[i].n_removed) for i in range(len(texts))] == [(len((t or "").encode()), 400 * (3 <= i < 6)) for i, t in enumerate(texts)]


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_that_are_many_stay_where_they_are(spark, monkeypatch):
    """Rows equal in all, and equal texts of many ids, joined by broadcast: the same result as by hash."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef ") for _ in range(90))
    rows = [(1, text)] * 30 + [(i, text) for i in range(40)] + [(100, "x" + text[:60]), (101, "alone in the world, and longer than forty bytes")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = sorted(map(str, suffixes.remove_repeats(df, 40).collect()))
    monkeypatch.setattr(_common, "KEY_ROWS", 3)
    monkeypatch.setattr(_common, "HEAVY", 20)
    assert sorted(map(str, suffixes.remove_repeats(df, 40).collect())) == plain
    assert sum("spans=[]" in r for r in plain) == 1
