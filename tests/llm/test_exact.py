"""Exact dedup against plain grouping."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import exact


def plain(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows; of repeated rows the first is kept."""
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for x, found in groups.items():
        best = min(found)
        out += [(i, best[4], len(found), at == best[3], hashlib.sha256(x.encode()).hexdigest()) for *_, at, i in found]
    return sorted(map(str, out))


def got(df, **kw):
    return sorted(str(tuple(r)) for r in exact.exact_duplicates(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.text("ab", max_size=6)), max_size=60))
def test_trie(steps):
    """Terminals of strings that prefix each other, with subtrees taken out between."""
    trie, held, out = exact.Trie(), {}, []
    for spill, text in steps:
        data = text.encode()
        leaf = trie.leaf(data)
        assert leaf.text == data and held.setdefault(data, leaf) is leaf
        if spill:
            gone = trie.heaviest()
            assert gone
            for leaf in gone:
                out.append(leaf.text)
                assert held.pop(leaf.text) is leaf
        assert trie.held == sum(len(t) + exact.NODE_BYTES for t in held)
    assert sorted(leaf.text for leaf in trie.take()) == sorted(held)


def rows_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t\v\f\r", "a b", "ab", " a  b ", "a b", "Ab", "é e", "ée", "x" * 200_000, "x" * 200_000 + " ", "x" * 199_999 + "y", "漢 字"]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 7))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(3, "a b"), (3, "a b"), (None, "a b"), (None, "lone"), (None, "lone  "), (7, "lone")] + [(1000 + i, "hot copy") for i in range(150)]


@pytest.mark.parametrize("kw", [{}, {"trie_bytes": 1500, "owner_bytes": 1000}, {"copies": 2}, {"copies": 3, "trie_bytes": 900}], ids=str)
def test_documents(spark, kw):
    """Whatever a trie may hold and however many copies an owner takes, the result is the same."""
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, node string, row int").repartition(7)
    assert got(df, **kw) == plain(rows)


def test_equal_hashes_do_not_make_texts_equal(spark, monkeypatch):
    """The bytes decide: with one hash for all, groups are as before."""
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "a a", "cc", "b b", "dd", "dd"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scanned = exact.staged(exact._scan(df.selectExpr("monotonically_increasing_id() as row", "doc_id", "cast(text as binary) as text"), (), 1 << 20), "t")
    texts = scanned.filter("row is null").withColumn("h", exact.F.lit(7).cast("long")).select("node", "size", "h", "text", "sha", "cp", "row0", "id0", "n")
    groups = exact._resolved(texts, 2, 1 << 20, 1 << 20, 100)
    assert sorted((r.id0, r.n) for r in groups.select("id0", "n").distinct().collect()) == [(2, 2), (3, 1), (4, 2), (5, 2)]


def test_bytes_that_are_no_utf8_and_text_ids(spark):
    raw = [(b"i", b"\xff a"), (b"j", b"\xffa"), (b"k", b"\xfea"), (b"l", b"\xc3\x28")]
    df = spark.createDataFrame([(i.decode(), bytearray(t)) for i, t in raw], "doc_id string, text binary")
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect()}
    assert out == {"i": ("i", 2, True), "j": ("i", 2, False), "k": ("k", 1, True), "l": ("l", 1, True)}


def test_rows_that_stay_and_empty(spark):
    rows = rows_of(2)
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, kept string, own int")
    stay = exact.deduplicated(df)
    assert stay.columns == df.columns
    want = [r for r in plain(rows) if ", True, " in r]
    assert stay.count() == len(want) and got(stay) == sorted(re.sub(r", \d+, True", ", 1, True", r) for r in want)
    assert exact.exact_duplicates(df.limit(0)).count() == 0
