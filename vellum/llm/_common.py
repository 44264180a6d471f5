"""What the operators of this subpackage share: table access, staging, arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python function holds at a time.
STEP_BYTES = 4 << 20
#: Bytes of a batch that Spark hands to Python, rows of a batch that it reads from Parquet: the
#: reader keeps room for a batch of texts for as long as a task runs, and no array of it is large.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512
#: Bytes of a row group of staged tables.
ROW_GROUP = 16 << 20

#: Paths that staged() wrote and that are still there.
_staged: dict[str, SparkSession] = {}
_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; a column that the file lacks is null."""
    # batches for Python of bounded bytes, whatever the texts' length
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c) for c in columns]) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session that
    names none (tests) gets a folder made here; any other has to name one."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: cuts the
    lineage, survives lost executors, and is computed once however often it is read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # small row groups: a writer holds one in the heap, and reading them is no slower
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that staged() returned and that nothing still to be computed reads."""
    for df in tables:
        _delete(getattr(df, "_vellum_path", ""))


def _delete(path: str) -> None:
    spark = _staged.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended, or this user may not delete; the folder's owner clears it
        pass


@atexit.register
def drop_staged() -> None:
    """Deletes the tables that staged() wrote; results that read them end with that. Runs by
    itself when the application ends."""
    for path in list(_staged):
        _delete(path)


#: Rows of one key that a task takes without ado; at most HEAVY keys have more than their share.
KEY_ROWS, HEAVY = 1 << 16, 1000


def join_many(many: DataFrame, one: DataFrame, on: list[str], weight: str) -> DataFrame:
    """The inner join of many and one on columns that are unique in `one` and not null. weight:
    a column of `one` (left out of the result) that counts a key's rows in `many`.

    Keys with more than KEY_ROWS rows and more than a thousandth of all go by broadcast: they
    are fewer than HEAVY, whatever the data, and so no key gathers in one task. many and one
    should be staged, since they are read twice where such keys exist."""
    total, most = one.agg(F.sum(weight), F.max(weight)).first()
    share = max(KEY_ROWS, (total or 0) // HEAVY)
    if (most or 0) <= share:
        return many.join(one.drop(weight), on)
    heavy = F.broadcast(one.filter(F.col(weight) > share).drop(weight))
    light = many.join(heavy.select(*on), on, "left_anti").join(one.filter(F.col(weight) <= share).drop(weight), on)
    return light.unionByName(many.join(heavy, on))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: Column, mod: int, rest: int = 1) -> Column:
    """crc32 of the key as text, modulo mod, equals rest; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % mod) == rest


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES):
    """Slices of the batches with about `most` bytes of the text column each (one row at
    least, rows are never cut), so that long texts do not add up in memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(column)
        lens = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < n:
            total, end = 0, at
            while end < n and (end == at or total + lens[end] <= most):
                total += int(lens[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end


def tidy(run):
    """The batch function, giving back what memory the worker keeps in reserve when the task ends:
    idle workers stay, and add up to what the executor may use."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts; bytes that are no UTF-8 become lone surrogates, from which `surrogateescape` brings them back."""
    return [(t or b"").decode("utf-8", "surrogateescape") for t in batch.column(column).cast(pa.binary()).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[memoryview, list[int]]:
    """The texts of a batch as one run of UTF-8 bytes, and n + 1 offsets into it."""
    col = pa.compute.fill_null(batch.column(column), "").cast(pa.large_binary())
    import numpy as np

    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    base, end = int(offs[0]), int(offs[-1])
    return (memoryview(data)[base:end] if data is not None else memoryview(b"")), (offs - base)
