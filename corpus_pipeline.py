"""A corpus pipeline over `documents`: quality classifier, SimHash near-dedup, suffix dedup,
source mixing, BPE. Each stage is written as Parquet and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, mixing, quality, simhash, suffixes
from vellum.llm._common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model, keep=COLUMNS).filter("score >= 0.5").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest doc_id, of several
    such rows the one of the least hash; in a group without any doc_id the least hash decides
    alone. Rows of different groups never displace each other, whatever their ids."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("h"))
    docs = docs.withColumn("at", key)
    found = simhash.near_duplicates(docs, doc_id="at")
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("first")).dropDuplicates()
    kept = docs.join(first, docs["at"] == first["first"], "left_semi")
    return kept.dropDuplicates(["at"]).select(*COLUMNS)  # rows equal in all of it are one


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words, of 150 bytes or more, whose every 150 bytes also begin
    elsewhere go, at all their places; a document of which nothing is left goes too. Characters stay whole: one
    that the end of a passage divides goes with it."""
    out = suffixes.remove_repeats(docs, length=150, least_words=51, whole_chars=True, keep=COLUMNS)
    cut = F.size("spans") > 0
    out = out.filter(~cut | (F.length("kept") > 0)).withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is taken; where the mix takes only its first
    words, it is cut after them."""
    docs = docs.withColumn("at", F.struct("doc_id", F.xxhash64("text", "lang", "source").alias("h")))
    pieces = mixing.mix(docs, doc_id="at").filter("slot is not null")
    drawn = pieces.groupBy("n_row", "doc_id", "size", "epoch").agg(F.sum("n_words").alias("words"))
    drawn = staged(drawn.select(F.col("doc_id").alias("at"), "size", "words"), "mix-drawn")
    rows = docs.dropDuplicates(["at"])  # rows equal in all of it: each is drawn for itself, from one of them
    mixed = rows.join(drawn, rows["at"].eqNullSafe(drawn["at"]))
    head = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.col("words").cast("int")), " ")
    mixed = mixed.withColumn("text", F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text")))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian 32-bit words), intact: whether the ids
    decode to the text again."""
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    back = bpe.round_trip(docs, ranks, pattern, keep=("doc_id", "source", "text"))
    intact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("source mixing", mixing_stage),
    ("byte-level bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
