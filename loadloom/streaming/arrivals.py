"""Forecasts that leave with each arrival of a measured series, and the rows that a watermark leaves behind."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadloom.operators.timeaxis import SERIES
from loadloom.sources.store import shared_folder

#: A forecast's correction: from the mean of the last few errors and of the last day's, with moments of what has come true.
LAST, RIDGE, WARM_UP = 4, 1e-3, 21
SCHEMA = f"{SERIES} string, issued_at timestamp, ts timestamp, h int, model double, correction double, pred double"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OnArrival(StatefulProcessor):
    """For each slot of a series, once it has come, the forecast of the ``horizons`` after it.

    Rows bring the load and the model's value of a slot, and the model's values of the slots after it (``ahead``). State of a series: the ring
    of the last day's errors, by target what waits for it to come true, and the moments of each horizon; its size is set by a day and the
    horizons, whatever the series' length. It is read once a trigger, and what changed is written back. Slots are taken in their order: one
    that comes before an earlier one waits in the state until that has come, or is given up once a slot ``patience`` later is there; a missing
    slot counts as unknown. What comes for a slot that was passed is left to the late path. So the forecasts don't depend on how the input
    is cut into triggers, as long as no slot is given up that would still have come.
    """

    def __init__(self, step: int, horizons: int, a_day: int, patience: int):
        self.step, self.horizons, self.a_day, self.patience = step, horizons, a_day, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "k long", "load double, model double, ahead array<double>")
        self.pending = handle.getMapState("pending", "target long", "h array<int>, x1 array<double>, xday array<double>, told array<double>")
        self.moments = handle.getValueState("moments", "g array<double>, n array<long>")
        self.ring = handle.getValueState("ring", "next long, k array<long>, e array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = {int(k[0]): tuple(v) for k, v in self.waiting.iterator()}
        stored, now, errors = set(waiting), None, {}
        if self.ring.exists():
            now, ks, es = self.ring.get()
            errors = dict(zip(map(int, ks), es, strict=True))
        for pdf in rows:
            for k, load, model, ahead in zip(pdf["k"], pdf["load"], pdf["model"], pdf["ahead"], strict=True):
                if now is None or k >= now:
                    waiting[int(k)] = (float(load), float(model), [float(x) for x in ahead[: self.horizons]])
        held = sorted(waiting)
        if not held:
            return
        now, newest, out = held[0] if now is None else now, held[-1], []
        pending = {int(k[0]): [list(x) for x in v] for k, v in self.pending.iterator()}
        kept, changed = set(pending), set()
        g, n = np.zeros((self.horizons, 5)), np.zeros(self.horizons, dtype=np.int64)
        if self.moments.exists():
            flat, count = self.moments.get()
            g, n = np.array(flat).reshape(-1, 5), np.array(count)
        at = 0
        while at < len(held) and (held[at] == now or newest - now >= self.patience):
            if held[at] == now:
                load, model, ahead = waiting.pop(now)
                at += 1
                due = pending.pop(now, None)
                if np.isfinite(load) and np.isfinite(model):
                    errors[now] = load - model
                    for h, x1, xday, told in zip(*(due or ((), (), (), ())), strict=True):
                        g[h] += (x1 * x1, x1 * xday, xday * xday, x1 * (load - told), xday * (load - told))
                        n[h] += 1
                errors = {k: e for k, e in errors.items() if k > now - self.a_day}
                lately = [errors[k] for k in range(now - LAST + 1, now + 1) if k in errors]
                usable = len(lately) >= LAST // 2 and len(errors) >= self.a_day // 2
                x1, xday = (float(np.mean(lately)), float(np.mean([errors[k] for k in sorted(errors)]))) if usable else (0.0, 0.0)
                for h, told in enumerate(ahead):
                    if np.isfinite(told):
                        c1, c2 = solved(g[h]) if usable and n[h] >= WARM_UP else (0.0, 0.0)
                        out.append((key[0], now, now + 1 + h, h, told, c1 * x1 + c2 * xday))
                        if usable:
                            for column, value in zip(pending.setdefault(now + 1 + h, [[], [], [], []]), (h, x1, xday, told), strict=True):
                                column.append(value)
                            changed.add(now + 1 + h)
            else:
                pending.pop(now, None)
            now += 1
        for state, before, after, fresh in ((self.waiting, stored, waiting, waiting.keys() - stored), (self.pending, kept, pending, changed & pending.keys())):
            for k in before - after.keys():
                state.removeKey((k,))
            for k in fresh:
                state.updateValue((k,), tuple(after[k]))
        self.moments.update((g.ravel().tolist(), n.tolist()))
        self.ring.update((now, list(errors), list(errors.values())))
        if out:
            found = pd.DataFrame(out, columns=[SERIES, "k", "target", "h", "model", "correction"])
            found["issued_at"], found["ts"] = (pd.to_datetime(x * self.step, unit="s") for x in (found["k"] + 1, found["target"]))
            found["pred"], found["h"] = found["model"] + found["correction"], found["h"].astype("int32")
            yield found[[SERIES, "issued_at", "ts", "h", "model", "correction", "pred"]]

    def close(self) -> None:
        pass


def solved(g: list[float]) -> tuple[float, float]:
    """Two ridge coefficients from the moments x1 x1, x1 xday, xday xday, x1 e, xday e."""
    a, b, d, p, q = g
    ridge = RIDGE * (a + d) / 2 + 1e-12
    a, d = a + ridge, d + ridge
    det = a * d - b * b
    return (p * d - b * q) / det, (a * q - b * p) / det


def forecasts(stream: DataFrame, step: int, horizons: int, a_day: int, patience: int = 8) -> DataFrame:
    """The forecasts of a stream of series_id, k (slot number since 1970), load, model and ahead (the model's values of the next slots). Streams
    that start later in the session keep their state in RocksDB, which this kind of state asks for."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select(SERIES, F.col("k").cast("long").alias("k"), F.col("load").cast("double").alias("load"), F.col("model").cast("double").alias("model"), "ahead")
    return rows.groupBy(SERIES).transformWithStateInPandas(OnArrival(step, horizons, a_day, patience), SCHEMA, "Append", "None")


def forecasts_batch(df: DataFrame, step: int, horizons: int, a_day: int) -> DataFrame:
    """The same forecasts by windows over a table: the features of every slot, and for each horizon the moments of the issues whose target had
    come true by the issue."""
    k = F.col("k")
    w = Window.partitionBy(SERIES).orderBy("k")
    e = F.when(F.col("load").isNotNull() & ~F.isnan("load") & ~F.isnan("model"), F.col("load") - F.col("model"))
    rows = df.withColumn("_e", e)
    over = lambda n: w.rangeBetween(-(n - 1), 0)
    usable = (F.count("_e").over(over(LAST)) >= LAST // 2) & (F.count("_e").over(over(a_day)) >= a_day // 2)
    rows = rows.withColumns({"x1": F.when(usable, F.avg("_e").over(over(LAST))), "xday": F.when(usable, F.avg("_e").over(over(a_day)))})
    laid = rows.select(SERIES, "k", "x1", "xday", F.posexplode(F.slice("ahead", 1, horizons)).alias("h", "told")).filter(~F.isnan("told") & F.col("told").isNotNull())
    truth = df.filter(e.isNotNull()).select(SERIES, F.col("k").alias("_t"), "load")
    known = laid.withColumn("_t", k + 1 + F.col("h")).join(truth, [SERIES, "_t"], "left")
    miss = F.col("load") - F.col("told")
    products = [F.col("x1") * F.col("x1"), F.col("x1") * F.col("xday"), F.col("xday") * F.col("xday"), F.col("x1") * miss, F.col("xday") * miss]
    # issue k at horizon h learns from issues whose target is at most k, so the sums are framed by the target's number
    upto = Window.partitionBy(SERIES, "h").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = known.filter(F.col("load").isNotNull() & F.col("x1").isNotNull()).select(SERIES, "h", F.col("_t").alias("k"), *(p.alias(f"_{i}") for i, p in enumerate(products)), F.lit(1).alias("_n"))
    both = known.select(SERIES, "h", "k", "x1", "xday", "told", "_t").unionByName(sums, allowMissingColumns=True)
    run = both.withColumns({f"_s{i}": F.coalesce(F.sum(f"_{i}").over(upto), F.lit(0.0)) for i in range(5)} | {"_m": F.coalesce(F.sum("_n").over(upto), F.lit(0))}).filter(F.col("_t").isNotNull())
    ridge = RIDGE * (F.col("_s0") + F.col("_s2")) / 2 + 1e-12
    a, b, d, p, q = F.col("_s0") + ridge, F.col("_s1"), F.col("_s2") + ridge, F.col("_s3"), F.col("_s4")
    det = a * d - b * b
    correction = F.when(F.col("x1").isNotNull() & (F.col("_m") >= WARM_UP), (p * d - b * q) / det * F.col("x1") + (a * q - b * p) / det * F.col("xday")).otherwise(0.0)
    return run.select(SERIES, F.timestamp_seconds((k + 1) * step).alias("issued_at"), F.timestamp_seconds(F.col("_t") * step).alias("ts"), "h", F.col("told").alias("model"), correction.alias("correction"), (F.col("told") + correction).alias("pred"))


def with_late_path(stream: DataFrame, value: str, width: str, late: str, trigger: dict | None = None) -> tuple[str, str]:
    """Hourly means of a stream as they close behind the watermark, and beside them all that came, so that nothing is lost: the folders of the
    closed windows and of the rows. ``settled`` merges the two."""
    from loadloom.streaming.series import to_archive, tumbling

    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    closed = tumbling(stream, value, width, late).writeStream.outputMode("append").foreachBatch(to_archive(f"{path}/closed"))
    rows = stream.writeStream.outputMode("append").foreachBatch(to_archive(f"{path}/rows"))
    started = [q.option("checkpointLocation", f"{path}/state-{i}").trigger(**(trigger or {"availableNow": True})).start() for i, q in enumerate((closed, rows))]
    for q in started:
        q.awaitTermination()
    return f"{path}/closed", f"{path}/rows"


def settled(closed: DataFrame, rows: DataFrame, value: str, width_seconds: int) -> DataFrame:
    """The windows of all rows, each with how it came about: ``closed`` as the stream gave it, ``revised`` where late rows changed it after it
    closed, ``late`` where all its rows were late, ``open`` where the watermark hasn't passed it.

    series_id, ts, value, n, before (the closed mean), state. Windows, not rows, meet in the join.
    """
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / width_seconds) * width_seconds)
    whole = rows.groupBy(SERIES, start.alias("_w")).agg(F.avg(value).alias(value), F.count(value).alias("n")).withColumnRenamed("_w", "ts")
    told = closed.select(SERIES, "ts", F.col(value).alias("before"), F.col("n").alias("_n"))
    ends = told.groupBy(SERIES).agg(F.max("ts").alias("_closed"))
    both = whole.join(told, [SERIES, "ts"], "left").join(ends, SERIES, "left")
    behind = F.coalesce(F.col("ts") <= F.col("_closed"), F.lit(False))
    state = F.when(F.col("_n") == F.col("n"), "closed").when(F.col("_n").isNotNull(), "revised").when(behind, "late").otherwise("open")
    return both.select(SERIES, "ts", value, "n", "before", state.alias("state"))
