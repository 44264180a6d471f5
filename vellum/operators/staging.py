"""Steps of iterative operators, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a local session names none (tests), a folder made here; on a
    cluster it must be named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="vellum-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read from there: the lineage ends here, and a lost
    executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that staged() returned and that nothing still to be computed reads."""
    for df in tables:
        _delete(getattr(df, "_vellum_path", ""))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever the session's file systems keep it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept_until_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends, as staged tables do."""
    _written[path] = spark


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        remove(spark, path)
    except Exception:  # the session has ended; the folder's owner clears it
        return


@atexit.register
def drop_staged() -> None:
    """Deletes what staged() wrote; results that read it end with that. Runs when the application ends."""
    for path in list(_written):
        _delete(path)
