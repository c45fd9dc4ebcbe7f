"""Measured series as streams: hourly windows, a stateful exponential filter, and sinks that may be written twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loadloom.operators.timeaxis import SERIES
from loadloom.sources.store import archive, shared_folder


def tumbling(stream: DataFrame, value: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Mean and count of each window; rows later than the watermark are dropped. With ``slide``, windows overlap."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    means = stream.withWatermark("ts", late).groupBy(SERIES, w.alias("w")).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return means.select(SERIES, F.col("w.start").alias("ts"), value, "n")


def sessions(stream: DataFrame, value: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of rows without a pause longer than ``gap``."""
    runs = stream.withWatermark("ts", late).groupBy(SERIES, F.session_window("ts", gap).alias("w"))
    return runs.agg(F.avg(value).alias(value), F.count(value).alias("n")).select(SERIES, F.col("w.start").alias("ts"), F.col("w.end").alias("until"), value, "n")


def filtered(stream: DataFrame, value: str, tau_hours: float, out: str = "ema") -> DataFrame:
    """Exponential filter over a stream: y <- y + (1 - exp(-dt / tau)) (x - y), dt being the time since the row before.

    Instants are microseconds; rows of one instant count as their mean. The state of a series is its last value and instant, whatever
    its length. Rows that come in a later batch at or before that instant are late: they are left out, and corrections go through the
    comparison of snapshots instead.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, y = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).dropna(subset=["t", value]).groupby("t", sort=True, as_index=False)[value].mean()
        rows = rows if last is None else rows[rows["t"] > last]
        if not len(rows):
            return
        t, x, found = rows["t"].to_numpy(), rows[value].to_numpy(dtype=float), np.empty(len(rows))
        for i in range(len(rows)):  # a recursion over the new rows of one series
            y = x[i] if last is None else y + (1 - np.exp(-(t[i] - last) / 3.6e9 / tau_hours)) * (x[i] - y)
            last, found[i] = int(t[i]), y
        state.update((last, float(y)))
        yield pd.DataFrame({SERIES: key[0], "t": t, value: x, out: found})

    rows = stream.select(SERIES, F.unix_micros("ts").alias("t"), F.col(value).cast("double").alias(value))
    schema = f"{SERIES} string, t long, {value} double, {out} double"
    found = rows.groupBy(SERIES).applyInPandasWithState(step, schema, "last long, y double", "append", GroupStateTimeout.NoTimeout)
    return found.select(SERIES, F.timestamp_micros("t").alias("ts"), value, out)


def to_archive(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a folder for each batch, so that a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def in_order(df: DataFrame, by, name: str, files: int) -> str:
    """A folder to stream from: the rows in ``files`` files in the order of ``by`` (a column or its name), written one after the other."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    key = F.col(by) if isinstance(by, str) else by
    first, last = df.agg(F.min(key), F.max(key)).first()
    if first is None:
        df.write.parquet(path)
        return path
    part = F.least(F.floor((key - first) * files / (last - first + 1)), F.lit(files - 1))
    for n in range(files):
        df.filter(part == n).coalesce(1).write.mode("append").parquet(path)
    return path


def run_available(result: DataFrame, mode: str = "append") -> str:
    """Process all that the source holds now, and return the archive's folder."""
    spark: SparkSession = result.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = result.writeStream.outputMode(mode).foreachBatch(to_archive(f"{path}/out")).option("checkpointLocation", f"{path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return f"{path}/out"


def latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The newest version of each key that an archive in update mode holds."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path).withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long"))
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def on_arrival(stream: DataFrame, act: Callable[[DataFrame], DataFrame], path: str | None = None) -> str:
    """After each arrival, a forecast from what has come: ``act`` makes it of the batch, with a column ``issued_at``; it is archived under its
    issue, so that a batch that is tried again replaces itself. Returns the archive's folder."""
    path = path or f"{shared_folder(stream.sparkSession)}/arrivals-{uuid.uuid4().hex}"

    def forecast(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            archive(act(batch), f"{path}/out")

    stream.writeStream.foreachBatch(forecast).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/out"
