"""Series as rows of arrays: one row for each series and some two months, with the weather that its filters remember.

Passes over a series then read a few wide rows without a shuffle, and build designs on whole arrays. A chunk's arrays are bounded by its
days, so memory is too, whatever the length of a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES
from loadloom.plans.design import FLAGS
from loadloom.sources.store import materialised

#: Days of a chunk, and chunks of weather before it: at least 25 of the longest time constants, so that what is left out is below rounding.
DAYS, BEFORE = 64, 2
WEATHER = ("temp", "sun", "wind")
FIELDS = ("t", "day", "tod", "daytype", "flags", "bridge_len", "periods", "summer_day", "dark", "gloom", "load", *WEATHER)
#: Forecast weather of the same rows, which issues use from their cutoff on; NaN where there is none.
FORECAST = tuple(f"forecast_{x}" for x in (*WEATHER, "gloom"))

assert DAYS * BEFORE * 24 >= 25 * max(s.high for s in (*C.HEATING_SHAPES, *C.COOLING_SHAPES) if s.name.startswith("tau"))


def with_day_masks(df: DataFrame) -> DataFrame:
    """Adds mild and cold: rows of days whose mean temperature suits the fit of the base (and the day's before is near it), or of heating."""
    day = df.groupBy(SERIES, "date_local").agg(F.avg("temp").alias("_mean"), ((F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))) / 3600).alias("_hours"))
    before = F.lag("_mean").over(Window.partitionBy(SERIES).orderBy("date_local"))
    (low, high), (low_before, high_before) = C.BASE["mild"], C.BASE["mild_before"]
    mild = F.col("_mean").between(low, high) & before.between(low_before, high_before) & (F.col("_hours") >= 22)
    day = day.select(SERIES, "date_local", F.coalesce(mild, F.lit(False)).alias("mild"), F.coalesce(F.col("_mean") <= C.HEATING["cold"], F.lit(False)).alias("cold"))
    return df.drop("mild", "cold").join(day, [SERIES, "date_local"])


def chunked(df: DataFrame, name: str = "chunks", forecast: DataFrame | None = None) -> DataFrame:
    """series_id, chunk, an array for each field, and the ``before_`` arrays of the weather of the chunks before, in the shared folder.

    ``df``: series_id, ts, weather, calendar columns, dark, gloom; load where it is known. ``forecast``: series_id, ts, weather and gloom.
    """
    rows = with_day_masks(df if "load" in df.columns else df.withColumn("load", F.lit(None).cast("double")))
    if forecast is not None:
        named = forecast.select(SERIES, "ts", *(F.col(x).alias(f"forecast_{x}") for x in (*WEATHER, "gloom") if x in forecast.columns))
        rows = rows.join(named, [SERIES, "ts"], "left")
    has = set(rows.columns)
    flag = lambda c, bit: F.when(F.coalesce(F.col(c), F.lit(False)), 1 << bit).otherwise(0) if c in has else F.lit(0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    values = {
        "t": F.unix_timestamp("ts"),
        "day": F.datediff("date_local", F.lit("1970-01-01")),
        "tod": F.col("tod"),
        "daytype": F.col("daytype").cast("int"),
        "flags": sum((flag(c, i) for i, c in enumerate(FLAGS)), F.lit(0)),
        "bridge_len": F.col("bridge_len").cast("int"),
        "periods": sum((F.when(F.array_contains("periods", p.name), 1 << i).otherwise(0) for i, p in enumerate(C.PERIODS)), F.lit(0)),
        "summer_day": F.col("summer_day").cast("double"),
        **{c: number(c) for c in ("dark", "gloom", "load", *WEATHER)},
        **{c: number(c) if c in has else F.lit(float("nan")) for c in FORECAST},
    }
    chunk = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01")) / DAYS).cast("int")
    sorted_rows = F.sort_array(F.collect_list(F.struct(*(v.alias(k) for k, v in values.items()))))
    each = rows.groupBy(SERIES, chunk.alias("chunk")).agg(sorted_rows.alias("_r"))
    each = each.select(SERIES, "chunk", *(F.col(f"_r.{k}").alias(k) for k in values))
    w = Window.partitionBy(SERIES).orderBy("chunk")
    none = F.array().cast("array<double>")
    lagged = lambda c: F.concat(*(F.coalesce(F.lag(c, k).over(w), none) for k in range(BEFORE, 0, -1)))
    each = each.withColumns({f"before_{x}": lagged(x) for x in WEATHER} | {f"before_{c}": F.coalesce(F.lag(c).over(w), none) for c in FORECAST[: len(WEATHER)]})
    # the chunks of few series spread over as many tasks as there are; those of many stay together, so that a task sends one sum for each
    spark = df.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = -(-cores // max(each.select(SERIES).distinct().count(), 1))
    spread = each.repartition(max(cores, 1), SERIES, F.pmod("chunk", F.lit(parts)))
    return materialised(spread, name)
