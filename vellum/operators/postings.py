"""An inverted index with block maxima, kept as Parquet, and BM25 over it.

Documents are numbered in the order of their ids, in spans of 65,536 numbers. The postings of a term in
a span are cut into blocks of 128: numbers as differences, counts, lengths, and the largest score that the
block holds. Blocks are partitioned by term, so a search reads the folders of its terms, and of these first
the maxima alone. The n-th largest maximum of a term is a score that n documents reach, so spans whose
maxima add up to less are out before a posting is read. In a span that is left, the blocks' edges divide the
numbers into intervals; they are visited from the highest sum of maxima on, and no block is decoded once no
interval can reach the n-th best score found. What is left out cannot be among the n best, so the answer is
the scan's, ties included.

The index knows its documents by id and content hash: refresh() counts words anew only where these changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import kept_until_end, release, remove, shared_dir, staged

#: Words are runs of word characters of the lower-case text.
WORD = r"(?U)\w+"
#: Postings of a block, bits of a document number inside its span.
BLOCK, SPAN_BITS = 128, 16
#: Postings of a term partition, about.
PARTITION = 4_000_000
#: Words that are counted at a time, bytes of a batch that Spark hands to Python.
STEP_WORDS, BATCH_BYTES = 1_000_000, 16 << 20
#: Numbers that become literals of a scan's filter; more are joined.
LITERALS = 1000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, h, words) to (id, h, len, terms, tfs), a document's terms in no set order. Words are counted as numbers, a slice of
    the batch at a time."""
    for batch in batches:
        ends = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_WORDS, "right")))
            part = batch.slice(at, end - at)
            at = end
            words = part.column("words")
            size = pc.list_value_length(words)
            coded = words.flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            of = np.repeat(np.arange(part.num_rows), pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
            pairs, tf = np.unique(of * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            edges = pa.array(np.searchsorted(pairs // many, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, x) for x in (coded.dictionary.take(pa.array(pairs % many)), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), size.cast(pa.int32()), *lists], names=["id", "h", "len", "terms", "tfs"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of numbered documents to their terms: the numbers, counts and lengths of those that hold it, by span."""
    for batch in batches:
        size = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
        if not size.sum():
            continue
        coded = batch.column("terms").flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        no, length = (np.repeat(pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False), size) for c in ("no", "len"))
        order = np.lexsort((no, code))
        code, no = code[order], no[order]
        span = no >> SPAN_BITS
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (span[1:] != span[:-1])))
        edges = pa.array(np.append(starts, len(no)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (no, batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[order], length[order].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[starts])), pa.array(span[starts]), pa.array(no[starts]), *lists], names=["term", "span", "lo", "nos", "tfs", "lens"])


#: Columns of the blocks; weights as in search.bm25.
BLOCKS = "bucket int, term string, span long, block int, lo long, hi long, n int, top double, gaps array<int>, tfs array<int>, lens array<int>"


def _cut(k1: float, b: float, average: float):
    """Of rows of _inverted() with their bucket, in the order of bucket, term, span, lo: blocks. What is held is a batch, and the last
    term's documents of one span."""

    def blocks(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """first: whether a row begins a term and span."""
        size = pc.list_value_length(rows.column("nos")).to_numpy()
        no, tf, length = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("nos", "tfs", "lens"))
        of = np.repeat(np.cumsum(first) - 1, size)
        order = np.lexsort((no, of))
        no, tf, length = no[order], tf[order], length[order]
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        place = np.arange(len(of)) - at[of]
        starts = np.flatnonzero(place % BLOCK == 0)
        ends = np.append(starts[1:], len(of))
        gaps = np.diff(no, prepend=no[:1]).astype(np.int32)
        gaps[starts] = 0
        top = np.maximum.reduceat(tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)), starts)
        head = rows.select(["bucket", "term", "span"]).take(pa.array(np.flatnonzero(first)[of[starts]])).combine_chunks()
        edges = pa.array(np.append(starts, len(of)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (gaps, tf, length)]
        own = [pa.array((place[starts] // BLOCK).astype(np.int32)), pa.array(no[starts]), pa.array(no[ends - 1]), pa.array((ends - starts).astype(np.int32)), pa.array(top), *lists]
        columns = [head.column(c).combine_chunks() for c in head.column_names]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns] + own, names=["bucket", "term", "span", "block", "lo", "hi", "n", "top", "gaps", "tfs", "lens"])

    def begins(rows: pa.Table) -> np.ndarray:
        new = [np.append(True, pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)) for c in (rows.column("term").combine_chunks(), rows.column("span").combine_chunks())]
        return new[0] | new[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            first = begins(held)
            last = int(np.flatnonzero(first)[-1])
            if last:
                yield blocks(held.slice(0, last), first[:last])
            held = held.slice(last)
        if held is not None:
            yield blocks(held, begins(held))

    return run


def _words(docs: DataFrame) -> DataFrame:
    """id, h, len, terms, tfs of documents (id, text), no shuffle."""
    src = docs.select("id", _hash().alias("h"), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))
    return src.mapInArrow(_counted, f"id {docs.schema['id'].dataType.simpleString()}, h long, len int, terms array<string>, tfs array<int>")


def _hash() -> Column:
    return F.xxhash64("text")


def _print(docs: DataFrame) -> tuple[int, int]:
    """Number of documents and sum of their hashes: equal for equal contents, in any order."""
    n, s = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", _hash()).cast("decimal(38,0)"))).first()
    return n, int(s or 0)


@dataclass(frozen=True)
class Report:
    """What a search read: blocks in all of its terms, blocks of spans that were left, blocks decoded."""

    blocks: int
    left: int
    decoded: int


class Index:
    """The index of a table of documents (id, text). id is unique and orders. A null text has no
    words, and no part in the average length."""

    def __init__(self, spark: SparkSession, root: str, k1: float, b: float):
        self.spark, self.root, self.k1, self.b = spark, root, k1, b
        self.version = self.print = self.docs = self.blocks = None
        self.n, self.average, self.buckets = 0, 1.0, 1
        self.retold = 0  # documents whose words the last build counted
        self.report: Report | None = None

    @staticmethod
    def build(docs: DataFrame, root: str | None = None, k1: float = 1.2, b: float = 0.75) -> Index:
        """Indexes the documents. The tables lie under root, else in the session's shared folder until the application ends."""
        spark = docs.sparkSession
        own = root or f"{shared_dir(spark)}/postings-{uuid4().hex}"
        if root is None:
            kept_until_end(spark, own)
        out = Index(spark, own, k1, b)
        out.refresh(docs)
        return out

    def refresh(self, docs: DataFrame) -> bool:
        """Brings the index up to date; whether there was anything to do. The new tables are whole before the old ones go."""
        docs = docs.select("id", "text")
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # whatever the texts' length
        now = _print(docs)
        if now == self.print:
            return False
        kept = None
        new = docs
        if self.docs is not None:
            per = lambda df: df.groupBy("id", "h").agg(F.count(F.lit(1)).alias("c"))
            same = staged(per(self.docs).join(per(docs.select("id", _hash().alias("h"))), ["id", "h", "c"], "left_semi").select("id", "h"), "same-documents")
            kept = self.docs.join(same, ["id", "h"], "left_semi").select("id", "h", "len", "terms", "tfs")
            new = docs.withColumn("h", _hash()).join(same, ["id", "h"], "left_anti").select("id", "text")
        told = staged(_words(new), "counted-words")
        every = told if kept is None else told.unionByName(kept)
        path = f"{self.root}/{uuid4().hex}"
        numbered = every.sortWithinPartitions("id").withColumn("no", F.monotonically_increasing_id())
        numbered.write.option("parquet.block.size", 16 << 20).parquet(path + "/docs")
        own = self.spark.read.schema(numbered.schema).parquet(path + "/docs")
        n, average, postings = own.agg(F.count(F.lit(1)), F.avg("len"), F.sum(F.size("terms"))).first()
        average, buckets = average or 1.0, 1 + (postings or 0) // PARTITION
        blocks = self._blocked(own, average, buckets)
        blocks.write.partitionBy("bucket").parquet(path + "/blocks")
        old, self.version = self.version, path
        self.print, self.n, self.average, self.buckets, self.docs = now, n, average, buckets, own
        self.retold = told.count()
        self.blocks = self.spark.read.schema(blocks.schema).parquet(path + "/blocks")
        release(told, *([same] if kept is not None else []))
        if old:
            remove(self.spark, old)
        return True

    def _blocked(self, docs: DataFrame, average: float, buckets: int) -> DataFrame:
        """bucket, term, span, block, lo, hi, n, top, and the arrays gaps, tfs, lens."""
        # a batch of documents gives one row for each of its terms, not one for each posting
        pieces = docs.select("no", "len", "terms", "tfs").mapInArrow(_inverted, "term string, span long, lo long, nos array<long>, tfs array<int>, lens array<int>")
        pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        pieces = pieces.repartition("bucket", F.pmod(F.xxhash64("span"), F.lit(16))).sortWithinPartitions("bucket", "term", "span", "lo")
        out = pieces.mapInArrow(_cut(self.k1, self.b, average), BLOCKS)
        # by term inside the files, so that their statistics tell which hold a term
        return out.sortWithinPartitions("bucket", "term", "span", "block")

    def search(self, terms: Sequence[str], n: int) -> DataFrame:
        """id, score of the n best documents, ties to smaller ids: those of search.bm25 and search.top. Terms are lower-case words; a
        repeated one counts as often. What was read is told in `report`."""
        return self.search_many({"": terms}, n).select("id", "score").orderBy(F.col("score").desc(), "id")

    def search_many(self, asked: Mapping[str, Sequence[str]], n: int) -> DataFrame:
        """query, id, score: the n best documents of each of the named queries (its terms), in one pass over the blocks of all their terms."""
        asked = {q: list(t) for q, t in asked.items() if t}
        none = self.docs.select(F.lit("").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
        terms = sorted({t for own in asked.values() for t in own})
        if not terms or n < 1:
            return none
        of = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets))).collect()})
        own = self.blocks.filter(F.col("bucket").isin(of) & F.col("term").isin(terms))
        held = {r["term"]: r for r in own.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")).collect()}
        self.report = Report(0, 0, 0)
        if not held:
            return none
        idf = {t: math.log(1 + (self.n - r["df"] + 0.5) / (r["df"] + 0.5)) for t, r in held.items()}
        # the n-th largest maximum of a term: so many documents reach it by this term alone. A span gives n of its own at most
        first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("top").desc()))
        tops = own.select("term", "span", "top").withColumn("no", first(["term", "span"])).filter(F.col("no") <= n)
        nth = {r["term"]: r["top"] for r in tops.withColumn("no", first(["term"])).filter(F.col("no") == n).select("term", "top").collect()}
        plans = []
        for q, ts in asked.items():
            times = Counter(t for t in ts if t in held)
            if times:
                plans.append((q, [t for t in ts if t in held], max((nth[t] * idf[t] * k for t, k in times.items() if t in nth), default=0.0) * (1 - 1e-12)))
        weights = self.spark.createDataFrame([(q, t, idf[t] * k, least) for q, ts, least in plans for t, k in Counter(ts).items()], "query string, term string, weight double, least double")
        bound = own.groupBy("span", "term").agg(F.max("top").alias("top")).join(F.broadcast(weights), "term")  # a row for each named term
        bound = bound.groupBy("span", "query", "least").agg(F.sum(F.col("top") * F.col("weight")).alias("most"))
        left = own.join(bound.filter(F.col("most") >= F.col("least")).select("span").distinct(), "span")
        scan = _scan(plans, idf, self.k1, self.b, self.average, n)
        found = staged(left.select("span", "term", "lo", "hi", "top", "gaps", "tfs", "lens").groupBy("span").applyInArrow(scan, "query string, no long, score double, blocks long, decoded long"), "bm25-hits")
        told = found.filter("no is null").agg(F.sum("blocks"), F.sum("decoded")).first()
        self.report = Report(sum(r["blocks"] for r in held.values()), told[0] or 0, told[1] or 0)
        hits = found.filter("no is not null").select("query", "no", "score")
        order = lambda *c: Window.partitionBy("query").orderBy(F.col("score").desc(), *c)
        hits = hits.withColumn("rank", F.rank().over(order())).filter(F.col("rank") <= n).drop("rank")  # with ties: at most n from each span
        names, few = self.docs.select("no", "id"), [r["no"] for r in hits.select("no").limit(LITERALS + 1).collect()]
        if len(few) <= LITERALS:
            names = names.filter(F.col("no").isin(few))
        return names.join(hits, "no").withColumn("rank", F.row_number().over(order("id"))).filter(F.col("rank") <= n).select("query", "id", "score")


def _scan(plans: list[tuple[str, list[str], float]], idf: dict[str, float], k1: float, b: float, average: float, n: int):
    """Of the blocks of one span: for each query (name, terms, least score) its n best documents (query, no, score), and a row without no that
    counts blocks and those decoded."""

    def run(group: pa.Table) -> pa.Table:
        name = np.array(group.column("term").to_pylist(), object)
        lo, hi, top = (group.column(c).to_numpy() for c in ("lo", "hi", "top"))
        lists = {c: group.column(c).combine_chunks() for c in ("gaps", "tfs", "lens")}
        rows: dict[str, np.ndarray] = {}
        for i, t in enumerate(name.tolist()):
            rows.setdefault(t, []).append(i)
        rows = {t: np.array(at)[np.argsort(lo[at], kind="stable")] for t, at in rows.items()}
        decoded: dict[int, tuple] = {}

        def block(i: int) -> tuple:
            """Numbers and scores of a block."""
            if i not in decoded:
                gaps, tf, size = (lists[c][i].values.to_numpy(zero_copy_only=False) for c in ("gaps", "tfs", "lens"))
                w = idf[name[i]]
                decoded[i] = lo[i] + np.cumsum(gaps.astype(np.int64)), w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
            return decoded[i]

        def best(terms: list[str], floor: float) -> tuple[np.ndarray, np.ndarray]:
            here_ = {t: rows[t] for t in terms if t in rows}
            nos, scores = np.zeros(0, np.int64), np.zeros(0)
            if not here_ or sum(idf[t] * top[rows[t]].max() for t in terms if t in rows) * (1 + 1e-12) < floor:
                return nos, scores
            edges = np.unique(np.concatenate([np.concatenate((lo[at], hi[at] + 1)) for at in here_.values()]))
            cover, most = {}, np.zeros(len(edges))
            for t in terms:  # a block covers an interval that begins inside it
                if t in rows:
                    at = rows[t]
                    k = np.searchsorted(lo[at], edges, "right") - 1
                    in_ = (k >= 0) & (hi[at][np.maximum(k, 0)] >= edges)
                    cover[t] = np.where(in_, at[np.maximum(k, 0)], -1)
                    most += np.where(in_, idf[t] * top[at[np.maximum(k, 0)]], 0.0)
            for k in np.argsort(-most, kind="stable").tolist():
                if most[k] * (1 + 1e-12) < floor or most[k] <= 0:
                    break
                first, end = edges[k], edges[k + 1] if k + 1 < len(edges) else edges[k]
                parts = []
                for t in terms:
                    if t in cover and cover[t][k] >= 0:
                        no, s = block(int(cover[t][k]))
                        i, j = np.searchsorted(no, (first, end))
                        parts.append((no[i:j], s[i:j]))
                here = np.unique(np.concatenate([p[0] for p in parts]))
                sums = np.zeros(len(here))
                for no, s in parts:  # in the order of the terms, as the scan adds
                    sums[np.searchsorted(here, no)] += s
                ok = sums >= floor
                nos, scores = np.concatenate((nos, here[ok])), np.concatenate((scores, sums[ok]))
                if len(nos) > n:
                    order = np.lexsort((nos, -scores))[:n]
                    nos, scores = nos[order], scores[order]
                    floor = max(floor, scores[-1])
            return nos, scores

        out = [(q, *best(terms, least)) for q, terms, least in plans]
        of = [q for q, nos, _ in out for _ in range(len(nos))]
        nos, scores, blank = [x for _, nos, _ in out for x in nos.tolist()], [x for *_, s in out for x in s.tolist()], [None]
        return pa.table(
            {"query": pa.array([*of, *blank], pa.string()), "no": pa.array([*nos, *blank], pa.int64()), "score": pa.array([*scores, *blank], pa.float64()), "blocks": pa.array([*blank * len(nos), len(lo)], pa.int64()), "decoded": pa.array([*blank * len(nos), len(decoded)], pa.int64())}
        )

    return run


#: Indexes of this application, by name.
_open: dict[str, Index] = {}


def opened(name: str, docs: DataFrame) -> Index:
    """The application's index of that name, brought up to date with the documents."""
    index = _open.get(name)
    if index is None or index.spark is not docs.sparkSession:
        index = _open[name] = Index.build(docs)
    else:
        index.refresh(docs)
    return index
