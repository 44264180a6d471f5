"""BPE against tiktoken, and the round trip."""

import hashlib
import random
import struct
from types import SimpleNamespace

import pyarrow as pa
import pytest
import tiktoken

from vellum.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_pieces_as_tiktoken(vocabulary):
    ranks, _, own = vocabulary
    merges, rng = bpe.Merges(ranks), random.Random(3)
    for n in (1, 2, 3, 17, 400, 20_000):
        for alphabet in ("a", "ab", "the quick", "éüß日本", "!?#"):
            piece = "".join(rng.choice(alphabet) for _ in range(n)).replace(" ", "")
            if piece:
                assert merges.encode_piece(piece.encode()) == own._core_bpe.encode_single_piece(piece.encode())


@pytest.mark.parametrize("shared", [1, 300, 1 << 18])
def test_pieces_together_as_tiktoken(vocabulary, monkeypatch, shared):
    ranks, _, own = vocabulary
    monkeypatch.setattr(bpe, "SHARED", shared)
    rng = random.Random(5)
    pieces = [b"", b"a", b"\0", b"\xff", b"the", b"\0\0\0a\0", b"a" * 700]
    for alphabet in ("a", "ab", " thequick", "éüß日本", "!?#", "\0\x01\x7f"):
        pieces += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))).encode() for _ in range(60)]
    pieces += [rng.randbytes(rng.randint(1, 30)) for _ in range(60)]
    got = bpe.Merges(ranks).encode_pieces(pieces)
    assert got == [struct.pack(f"<{len(i)}I", *i) for i in (own._core_bpe.encode_single_piece(p) if p else [] for p in pieces)]
    assert bpe.Merges(ranks).encode_pieces([]) == []


def test_a_merge_that_brings_up_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"xyzy": 256, b"xyz": 257, b"yz": 258}
    own = tiktoken.Encoding("falling", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    pieces = [b"xyzyz", *("".join(rng.choice("xyz") for _ in range(rng.randint(1, 30))).encode() for _ in range(300))]
    got = bpe.Merges(ranks).encode_pieces(pieces)
    assert got[0] == struct.pack("<2I", 256, ord("z"))
    assert got == [struct.pack(f"<{len(i)}I", *i) for i in map(own._core_bpe.encode_single_piece, pieces)]


@pytest.mark.parametrize("cache, many", [(600_000, 1 << 18), (50, 40)])
def test_new_words_share_a_queue(vocabulary, monkeypatch, cache, many):
    ranks, pattern, own = vocabulary
    rng, alone = random.Random(7), []
    texts = [" ".join("".join(rng.choice("etaoinéè") for _ in range(rng.randint(4, 14))) for _ in range(n)) for n in (0, 1, 30, 500, 7)]
    monkeypatch.setattr(bpe, "CACHE", cache)
    monkeypatch.setattr(bpe, "PIECES", many, raising=False)
    one = bpe.Merges.encode_piece
    monkeypatch.setattr(bpe.Merges, "encode_piece", lambda self, piece: alone.append(piece) or one(self, piece))
    run = bpe._encoder(SimpleNamespace(value=ranks), f"test-{cache}", pattern, ())
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, "z" * 90], pa.string())], names=["__text"])
    got = [x for out in run(iter([batch])) for x in out.column("ids").to_pylist()]
    assert got == [struct.pack(f"<{len(i)}I", *i) for i in map(own.encode_ordinary, [*texts, "z" * 90])]
    if many > 999:  # else words are forgotten and come again
        assert len(alone) == 1  # the long one; a queue for each word is what took most of the time


def test_whole_texts(spark, vocabulary):
    ranks, pattern, own = vocabulary
    texts = [None, "", " ", "\n\n x", "don't stop 123  　 done\u0085", "x" * 30_000, "tie tie tie", "tie tie tie", "<|endoftext|>"]
    df = spark.createDataFrame([(i if i != 3 else None, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, ids binary")
    got = bpe.decode(bpe.encode(df, ranks, pattern), ranks).collect()
    assert len(got) == len(texts)
    want = sorted((t or "").encode() for t in texts)
    assert sorted(bytes(r.decoded) for r in got) == want
    ids = {bytes(r.decoded): bytes(r.ids) for r in got}
    for t in texts:
        assert ids[(t or "").encode()] == b"".join(struct.pack("<I", i) for i in own.encode_ordinary(t or ""))
    assert bpe.encode(df.limit(0), ranks, pattern).count() == 0


def test_bytes_that_are_no_utf8(spark, vocabulary):
    ranks, pattern, own = vocabulary
    raw = [b"ok \xff\xfe then", b"\xc3", b"\xed\xa0\x80 half", b"caf\xc3\xa9", b"\x80" * 300]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id long, text binary")
    got = {r.doc_id: r for r in bpe.round_trip(df, ranks, pattern).collect()}
    assert [bytes(got[i].decoded) for i in range(len(raw))] == raw
    assert bytes(got[3].ids) == b"".join(struct.pack("<I", i) for i in own.encode_ordinary("café"))


def test_query(spark, vocabulary):
    _, _, own = vocabulary
    got = {r.doc_id: r for r in bpe.op5_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
