"""Names that are too many for the driver."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from vellum.operators import names


def stands(name: str, text: str) -> bool:
    return re.search(rf"(?<![\w-]){re.escape(name)}(?![\w-])", text) is not None


def test_many_names_stay_off_the_driver(spark, monkeypatch):
    told, fetched = [], []
    broadcast, kind = type(spark.sparkContext).broadcast, type(spark.range(1))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: told.append(v) or broadcast(self, v))
    for name, real in (("toLocalIterator", kind.toLocalIterator), ("collect", kind.collect)):
        monkeypatch.setattr(kind, name, lambda self, *a, real=real: [fetched.append(r) or r for r in real(self, *a)])
    called = spark.range(50_000).selectExpr("concat('n', id) as node", "concat('someone number ', id, repeat('x', 100)) as called")
    texts = spark.range(0, 50_000, 1000).selectExpr("id", "concat('ask someone number ', id, repeat('x', 100), '.') as text")
    found = names.named(texts, called, 1 << 20)
    assert sum(len(r) for r in fetched) < 100, fetched
    assert told and all(isinstance(v, np.ndarray) and v.nbytes < 1 << 18 for v in told), told
    assert {(r.id, r.node) for r in found.collect()} == {(i, f"n{i}") for i in range(0, 50_000, 1000)}


def test_a_name_of_many_texts_is_dealt(spark):
    texts = spark.range(300).selectExpr("id", "concat('all say hello, some ', id) as text")
    called = spark.createDataFrame([("a", "hello"), ("b", "hello"), ("c", "7"), ("d", "say"), ("d", "say hello")], "node string, called string")
    want = {(i, n, z) for i in range(300) for n, z in (("a", 5), ("b", 5), ("d", 3), ("d", 9))} | {(7, "c", 1)}
    for crowd in (7, 1 << 18):
        rows = [tuple(r) for r in names._joined(texts, called, crowd).select("id", "node", "size").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_long_names_and_long_texts(monkeypatch):
    """Runs of tokens in pieces of texts, names longer than what is looked up everywhere."""
    monkeypatch.setattr(names, "MOST_TOKENS", 3)
    monkeypatch.setattr(names, "STEP", 17)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  -.,é😀") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [None, "", "a" * 100]
    own = {t[i : i + n] for t in texts if t for i, n in ((rng.randrange(len(t)), rng.randint(1, 30)) for _ in range(15))} | {"zz", "a" * 100}
    own = sorted(own)
    batch = pa.RecordBatch.from_arrays([pa.array(own)], names=["called"])
    keys = [(r["tokens"], r["h"]) for b in names._keys(iter([batch])) for r in b.to_pylist()]
    assert sum(k == 0 for k, _ in keys) > 20
    bits = np.zeros(1 << names.BLOCK_BITS, bool)
    for at in names._places(np.array([h for _, h in keys], np.int64).view(np.uint64), 1)[1]:
        bits[at] = True
    run = names._hits(SimpleNamespace(value=np.packbits(bits, bitorder="little")), 1, sorted({k for k, _ in keys if k}), max(map(len, own)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = {(r["id"], r["called"]) for b in run(iter([batch])) for r in b.to_pylist()}
    want = {(i, n) for i, t in enumerate(texts) for n in own if t and stands(n, t)}
    assert len(want) > 200 and {x for x in got if x[1] in own} == want and len(got) < len(want) + 20
