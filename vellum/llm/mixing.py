"""Mixing sources to target weights along a low-discrepancy schedule.

Golden-ratio points, one for each slot of the mix, fall through the cumulative target
shares and name the slot's source, so that every stretch of the schedule holds each
source in its proportion. A source's documents, shuffled by a seeded hash, form a stream
of words that repeats as often as its target needs; the stream is cut into as many blocks
of equal word counts as the source has slots, and its block number k goes to its slot of
rank k. Everything is DataFrame code; a source that holds a third of all rows is spread
over hash buckets, whose prefix sums are taken in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, parts, staged, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source gives at most so many times its own words.
MOST = 3
#: Words of a block, on average over the mix.
BLOCK_WORDS = 4096
#: 2**31 divided by the golden ratio, made odd: the step of the golden-ratio points.
GOLDEN, UNIT = 1327217885, 1 << 31
#: Rows of a hash bucket, about.
BUCKET_ROWS = 2048
#: Sources that one task ranks.
SOURCES = 100_000
#: Cells over the unit interval in which points meet source ranges.
CELLS = 1024


def _running(df: DataFrame, order: list, sums: dict[str, Column], tasks: int) -> DataFrame:
    """df with `rank`, from 0, and the named sums over all rows before, in the given order. Two
    levels from the second task on: inside ranges of the order, and over the ranges."""
    every = {"rank": F.lit(1), **sums}
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if tasks == 1:
        return df.select("*", *[before(Window.orderBy(*order), x).alias(n) for n, x in every.items()])
    ranged = staged(df.repartitionByRange(tasks, *order).withColumn("p", F.spark_partition_id()), "mix-ranges")
    whole = ranged.groupBy("p").agg(*[F.sum(x).alias(n) for n, x in every.items()])  # a row for each range
    whole = whole.select("p", *[before(Window.orderBy("p"), F.col(n)).alias("b_" + n) for n in every])
    inner = ranged.select("*", *[before(Window.partitionBy("p").orderBy(*order), x).alias("i_" + n) for n, x in every.items()])
    return inner.join(F.broadcast(whole), "p").select(*df.columns, *[(F.col("i_" + n) + F.col("b_" + n)).alias(n) for n in every])


def _targets(sizes: DataFrame, weights: tuple[float, ...], most: int, per_task: int = SOURCES) -> DataFrame:
    """sr (rank), source, source_size, n_docs, target, lo, hi (share of the unit interval).

    The level at which capped sources stop is found in closed form: in order of
    size / weight, a source is capped if the level of those from it on exceeds its cap.
    The table has a row for each source."""
    by = staged(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_docs")), "mix-sources")
    tasks = 1 + by.count() // per_task
    by = _running(by, [F.col("source").asc_nulls_last()], {}, tasks).withColumn("sr", F.col("rank").cast("int")).drop("rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = staged(by.withColumn("w", F.element_at(cycle, (F.col("sr") % len(weights) + 1).cast("int"))), "mix-ranks")
    total, all_w = by.agg(F.sum("source_size"), F.sum("w")).first()
    total, cap, pull = total or 0, most * F.col("source_size"), F.col("source_size") / F.col("w")
    by = _running(by, [pull, F.col("sr")], {"less": F.col("source_size"), "less_w": F.col("w")}, tasks)
    by = staged(by.withColumn("level", (F.lit(total) - most * F.col("less")) / (F.lit(all_w) - F.col("less_w"))), "mix-levels")
    # once a source is not capped, none after it is: the level holds for all of them
    open_ = by.filter(F.col("level") * F.col("w") <= cap).agg(F.min(F.struct(pull.alias("pull"), "sr", "level"))["level"]).first()[0]
    by = by.withColumn("target", cap.cast("double") if open_ is None else F.least(cap.cast("double"), F.lit(open_) * F.col("w")))
    by = by.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long")).select("sr", "source", "source_size", "n_docs", "target", "words")
    by = _running(by, [F.col("sr")], {"upto": F.col("words")}, tasks)
    all_words = by.agg(F.sum("words")).first()[0]
    share = lambda x: x / F.lit(float(all_words)) if all_words else F.lit(0.0)
    return by.select("sr", "source", "source_size", "n_docs", "target", share(F.col("upto")).alias("lo"), share(F.col("upto") + F.col("words")).alias("hi"), "words")


def _schedule(spark: SparkSession, targets: DataFrame, slots: int) -> DataFrame:
    """sr, k (rank among the source's slots), slot: one row for each slot of the mix.
    A source with words to give that no point meets gets one slot behind the others."""
    i = F.col("id")
    points = spark.range(slots).select(i.alias("slot"), ((i % UNIT * GOLDEN + GOLDEN // 2) % UNIT / float(UNIT)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    ranges = targets.filter("words > 0").select("sr", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)).cast("int"))).alias("cell"))
    met = points.join(ranges, "cell").filter("x >= lo and x < hi").select("sr", "slot", F.floor(F.col("slot") / 4096).alias("chunk"))
    counts = met.groupBy("sr", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("sr").orderBy("chunk")) - F.col("n"))
    k = F.row_number().over(Window.partitionBy("sr", "chunk").orderBy("slot")) - 1 + F.col("base")
    ranked = met.join(counts, ["sr", "chunk"]).select("sr", k.alias("k"), "slot")
    lone = targets.filter("words > 0").join(met.select("sr").distinct(), "sr", "left_anti")
    return ranked.unionByName(lone.select("sr", F.lit(0).cast("long").alias("k"), (F.lit(slots) + F.col("sr")).cast("long").alias("slot")))


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row for each piece of the mix: slot, doc_id, source, size, source_size, target,
    n_row (numbers the input rows), epoch, first_word, n_words. A document of which the
    mix takes nothing has one row with null slot, epoch and first_word and 0 words.

    A null or empty text has size 0 and is never taken. A null source is a source of its
    own, last in order. Repeated rows are documents of their own. Ties in the shuffled
    order fall by doc_id, size and text hash, so reruns agree. An empty table gives an empty
    result. Whole texts are counted, however long. Only the three named columns are read, others
    cannot clash.
    """
    spark = df.sparkSession
    body = F.col(text).cast("string")
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(body).alias("th"),
    )
    # equal rows are counted, so that no bucket fills with them
    sizes = rows.groupBy("doc_id", "source", "size", "th").agg(F.count(F.lit(1)).alias("copies"))
    sizes = staged(sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "th")), "mix-sizes")
    targets = staged(_targets(sizes, weights, most), "mix-targets")
    n, words, copied = sizes.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("copies")), F.max("copies")).first()
    slots = -(-(words or 0) // block_words)
    schedule = staged(_schedule(spark, targets, slots), "mix-schedule")

    nb = max(1, n // BUCKET_ROWS)
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "doc_id", sizes["source"], "size", "copies", "h", "th", "sr", "source_size", "target", "words", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(nb)).cast("int").alias("b")
    )
    all_of = F.col("size") * F.col("copies")
    sums = rows.groupBy("sr", "b").agg(F.sum(all_of).alias("bw"))
    sums = sums.select("sr", "b", (F.sum("bw").over(Window.partitionBy("sr").orderBy("b")) - F.col("bw")).alias("base"))
    order = Window.partitionBy("sr", "b").orderBy("h", "doc_id", "size", "th")
    at = F.sum(all_of).over(order.rowsBetween(Window.unboundedPreceding, 0)) - all_of
    rows = rows.withColumn("in_b", at).withColumn("no", F.row_number().over(order)).join(sums, ["sr", "b"])
    if (copied or 0) > BUCKET_ROWS:  # many copies of a row are dealt to several tasks
        rows = rows.withColumn("c0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BUCKET_ROWS).cast("long")))).repartition(parts(spark), "sr", "b", "no", "c0")
    else:
        rows = rows.withColumn("c0", F.lit(0).cast("long"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("c0"), F.least(F.col("c0") + BUCKET_ROWS, F.col("copies")) - 1)))
    blocks = schedule.groupBy("sr").agg(F.count(F.lit(1)).alias("n_slots"))
    rows = rows.join(blocks, "sr", "left").withColumn("start", F.col("base") + F.col("in_b") + F.col("copy") * F.col("size"))
    # the stream repeats: epoch e holds the document's words from e * source_size + start on
    begin = F.col("epoch") * F.col("source_size") + F.col("start")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    rows = rows.withColumn("from", begin).withColumn("to", F.least(begin + F.col("size"), F.col("words")))
    rows = rows.filter("epoch = 0 or from < to")
    # the first r blocks have b + 1 words, the others b
    rows = rows.withColumn("bs", F.expr("words div n_slots")).withColumn("r", F.expr("words % n_slots"))
    block = lambda p: F.expr(f"case when {p} < r * (bs + 1) then {p} div (bs + 1) else r + ({p} - r * (bs + 1)) div bs end")
    blocks_of = F.when(F.col("from") < F.col("to"), F.sequence(block("from"), block("(to - 1)")))
    rows = rows.withColumn("k", F.explode_outer(blocks_of))
    first = F.expr("k * bs + least(k, r)")
    rows = rows.withColumn("p0", F.greatest(F.col("from"), first)).withColumn("p1", F.least(F.col("to"), first + F.col("bs") + F.when(F.col("k") < F.col("r"), 1).otherwise(0)))
    # rows that the mix takes nothing of meet no slot, and are spread
    rows = rows.withColumn("k_", F.coalesce("k", -1 - F.pmod("h", F.lit(1 << 20))))
    return rows.join(schedule.withColumnRenamed("k", "k_"), ["sr", "k_"], "left").select(
        "slot", "doc_id", "source", "size", "source_size", "target",
        F.struct("sr", "b", "no", "copy").alias("n_row"),
        F.when(F.col("k").isNotNull(), F.col("epoch")).alias("epoch"),
        F.when(F.col("k").isNotNull(), F.col("p0") - F.col("from")).alias("first_word"),
        F.when(F.col("k").isNotNull(), F.col("p1") - F.col("p0")).otherwise(0).cast("long").alias("n_words"),
    )


def taken(pieces: DataFrame) -> DataFrame:
    """The pieces added up: one row for each input row, with the words the mix takes."""
    return pieces.groupBy("n_row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("n_words").alias("taken"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes `documents`: doc_id, size, source_size, target, taken."""
    pieces = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return taken(pieces).select("doc_id", "size", "source_size", "target", "taken")
