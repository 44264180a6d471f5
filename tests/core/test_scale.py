"""Plans whose tasks stay small when tables grow."""

import random
from collections import Counter

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from vellum.operators import checks, postings, resolve, validate
from vellum.sources.vault import loaded


@pytest.fixture
def plain_joins(spark):
    """No join that the planner turns into a broadcast by itself, no adaptive plan."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_properties_meet_specs_where_they_lie(spark, plain_joins):
    props = spark.createDataFrame([("a", "t", "k", False, False, [("str", "x")])], "node string, type string, key string, is_list boolean, is_map boolean, items array<struct<tag:string,str:string>>")
    specs = spark.createDataFrame([("t", "k", "enum", ["y"], [], False, False, True)], "class string, name string, kind string, allowed array<string>, ranges array<string>, many boolean, soft boolean, required boolean")
    found = checks.enum_violations(checks.specced(props, specs))
    assert found.count() == 1 and "SortMergeJoin" not in plan(found)


def test_references_without_a_key_are_dealt_to_all_tasks(spark, plain_joins):
    table = spark.createDataFrame([("a", 1)], "_path string, c int")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("value"), F.when(F.col("id") == 0, "a").alias("_path"))
    got = resolve.met(rows, table, "_path", ["value"]).withColumn("p", F.spark_partition_id()).cache()
    assert got.count() == 1000 and [r["value"] for r in got.filter("c = 1").collect()] == ["0"]
    assert got.groupBy("p").count().agg(F.max("count")).first()[0] < 500


def test_lookups_and_files_are_no_hash_tables(spark):
    notes = spark.createDataFrame([("n/a.md", "[a](b.md) [[c]]")], "rel string, text string")
    files = spark.createDataFrame([("n/a.md",)], "rel string")
    found = validate.broken_links(notes, files)
    assert found.count() == 2 and "BroadcastHashJoin" not in plan(found)


def test_frontmatter_loads_as_by_the_plain_loader():
    rng = random.Random(3)
    bits = ["a", "b: ", "- ", "\n", "\n  ", "[", "]", "{", "}", ", ", ":", ": ", "#", " #", "'", '"', "2026-01-02", "1.5", "yes", "null", "~", "ü", "0x1F", "12:30", "<<: ", "=", "@", "`", "\t", "|", "\\n", "\\", "---\n", "...", "\r\n", "\r"]

    def told(load, text):
        try:
            return repr(load(text))
        except (yaml.YAMLError, ValueError, RecursionError) as exc:
            return f"{type(exc).__name__}: {exc}"

    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert told(loaded, text) == told(yaml.safe_load, text), repr(text)


def test_words_are_counted_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(postings, "STEP_WORDS", 5)
    words = [["a", "b", "a"], None, [], ["c"] * 9, ["b"], ["a", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array(words, pa.list_(pa.string()))], names=["id", "h", "words"])
    parts = list(postings._counted(iter([batch])))
    got = [(r["id"], r["len"], dict(zip(r["terms"], r["tfs"], strict=True))) for p in parts for r in p.to_pylist()]
    assert len(parts) == 3 and got == [(i, None if w is None else len(w), dict(Counter(w or ()))) for i, w in enumerate(words)]


def test_blocks_are_cut_over_batches():
    docs = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([2] * 300, pa.int32()), pa.array([["a"]] * 300, pa.list_(pa.string())), pa.array([[2]] * 300, pa.list_(pa.int32()))], names=["no", "len", "terms", "tfs"])
    pieces = [p.append_column("bucket", pa.array([0], pa.int32())) for p in postings._inverted(docs.slice(i, 70) for i in range(0, 300, 70))]
    rows = [r for b in postings._cut(1.2, 0.75, 2.0)(iter(pieces)) for r in b.to_pylist()]
    assert len(pieces) == 5 and [(r["block"], r["lo"], r["hi"], r["n"]) for r in rows] == [(0, 0, 127, 128), (1, 128, 255, 128), (2, 256, 299, 44)]
    assert all(r["gaps"] == [0] + [1] * (r["n"] - 1) and r["top"] == 2 * 2.2 / (2 + 1.2) for r in rows)
