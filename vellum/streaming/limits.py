"""Streams: a rate limiter with state, audit logs. Changed files: see sources.store.on_change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import allowed_by_rate


def rate_limited_stream(attempts: DataFrame, key: str, time: str, order: str, most: int, window: float = 60.0) -> DataFrame:
    """A stream of attempts with ok, each key under its own limit. The state of a key is the
    accepted times of one window, so it does not grow; late attempts of a batch are put in
    order of time within the batch."""
    fields = [f for f in attempts.schema if f.name != "ok"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ok boolean"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([time, order])
        seconds = (pd.DatetimeIndex(rows[time]).as_unit("ns").asi8 / 1e9)
        ok = allowed_by_rate(seconds.tolist(), most, window, held)
        state.update((held,))
        yield rows.assign(ok=ok)[[f.name for f in fields] + ["ok"]]

    return attempts.groupBy(key).applyInPandasWithState(run, schema, "held array<double>", "append", "NoTimeout")


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Audit lines (JSON) as they are appended: ts, tool, phase, ok, detail."""
    return spark.readStream.schema("ts string, tool string, phase string, ok boolean, detail string").json(folder)


def audit_counts(lines: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """start, tool, calls, refused: results by window of time, with a watermark."""
    timed = lines.filter("phase = 'result'").withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", every), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("refused"))
    return by.select(F.col("window.start").alias("start"), "tool", "calls", "refused")
