"""Fill-in-the-middle against plain slicing."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import fim


def plain(key, text, unit="character"):
    """n, form, prefix, middle, output by lists of units."""
    text = text or ""
    units = {"character": list, "word": lambda t: re.findall(r"(?s)^[ \t-\r]*[^ \t-\r]*[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", t) if t else [], "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}[unit](text)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 300), st.integers(0, 320))
def test_select(marks, k):
    at = [i for i in range(320) if marks >> i & 1]
    assert fim.select(marks, k, 320) == (at[k] if k < len(at) else 320)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a<PSM> \n\tß漢😀"), max_size=90))
def test_masks(text):
    data = text.encode()
    assert fim.characters(data).bit_count() == len(text)
    for s in fim.SENTINELS:
        assert fim.holds(data, s.encode()) == (s in text)
    assert fim.lines(data).bit_count() == len(re.findall(r"[^\n]*\n|[^\n]+", text))


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_documents(spark, unit):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "é", "<P>", "x <M> y", "<P", "P><S", "<", "<<", "<S<S<S", "漢字かな😀" * 50, "a b\n" * 4000, "x" * 300_000, "ends <"]
    texts += ["".join(rng.choice("ab <PS>M\n é😀") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "out", 7) for i, t in enumerate(texts)] + [(3, "a", "out", 7), (None, "no id at all", "out", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    out = fim.transform(df, unit=unit)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    want = [(i, *plain("" if i is None else i, t, unit), t or "") for i, t, _, _ in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_bytes_that_are_no_utf8(spark):
    raw = [b"\x80\x80abc", b"\xff\xfe" * 30, b"ok\xc3", b"\xe2\x82<P>"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id long, text binary")
    out = fim.transform(df)
    back = out.select("doc_id", "n", F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in back] == [hashlib.sha256(b).hexdigest() for b in raw]
    assert [r.n for r in back] == [4, 60, 3, 4]


def test_other_sentinels_and_empty(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    df = spark.createDataFrame([(str(i), f"text number {i} <P>") for i in range(40)], "doc_id string, text string")
    out = fim.transform(df, seed=9, plain=0, sentinels=marks)
    assert out.filter("form = 'plain'").count() == 0
    assert out.join(df, "doc_id").filter(fim.restored(F.col("output"), F.col("form"), marks) != F.col("text")).count() == 0
    assert fim.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, sentinels=("<P>", "<S>", "S<M>"))
