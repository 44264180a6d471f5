"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import spelling


def counted(rows):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def edits(w, letters):
    for i in range(len(w) + 1):
        yield w[:i] + w[i + 1 :]
        for c in letters:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1 :]


def plain(words, ratio=10):
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edits(w, letters) if x != w and x in words} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=500, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_near(a, b):
    assert spelling.near(a, b) == (a != b and b in set(edits(a, "ab")))


@pytest.mark.parametrize(("tile", "shard"), [(8192, 100_000), (5, 40), (1, 1000)])
def test_variants(spark, tile, shard):
    """Chains of forms, ties, hot segments in tiles, words longer than the automaton holds."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(260)}
    words |= {"prefix" + x + y for x in "abcdef" for y in "abcdef"} | {"suffix", "suffixx", "xsuffix"}
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    words |= {long, long[:150] + "z" + long[151:], long[:3] + long[4:], long + "q", "q" + long, long[:-1] + "r", long[:40] + long[42:]}
    words = {w: rng.choice([2, 2, 3, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df, tile=tile, shard=shard)) == plain(words)


def test_documents(spark):
    rng = random.Random(5)
    base = ["testing", "Éducation", "straße", "wonderful", "ÜBERMUT", "cafés×fin", "division÷x", "abcdefg", "abcdefgh", "MixedCase"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice([" ", ", ", "1", "\n"]) for _ in range(40))) for i in range(300)]
    rows += [(None, "testing testing nullid nullidd"), (7, None), (8, ""), (9, "short a b"), (3, rows[3][1]), (11, "tesxing " * 2000), (12, "漢字testing漢字testing")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    words = spelling.word_counts(df)
    want = counted(rows)
    assert {r.word: r.n for r in words.collect()} == want
    out = got(spelling.variants(words))
    assert out == plain(want) and any(r[1] for r in out)


def test_empty_and_bad_ratio(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(df)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(df), ratio=1)
