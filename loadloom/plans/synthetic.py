"""Series with known truth, made in Spark: weather, calendar effects, heating, cooling and solar generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadloom.functions import physics as P
from loadloom.functions import solar as S
from loadloom.operators import calendar as K
from loadloom.operators.windows import ema_many
from loadloom.plans.design import SIGNALS, star

TRUTH = {"a": 0.0135, "b": 0.0, "t_b": 16.8, "s": 2.0, "w": 0.35, "tau": 80.0, "alpha": 0.012, "a_c": 0.02, "t_bc": 17.8, "s_c": 2.0, "w_c": 0.35, "tau_c": 38.0, "alpha_c": 0.0, "gamma": 0.004}


def noise(*keys: Column | int) -> Column:
    """Uniform from -1 to 1, a function of its keys."""
    return (F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)), F.lit(20001)) - 10000) / 10000.0


def weather(spark: SparkSession, first: str, days: int, series: int | DataFrame = 1, minutes: int = 15) -> DataFrame:
    """temp, sun and wind on a regular axis: seasons, days, and smooth noise from day to day; for so many series, or those of a table's
    ``series_id``."""
    names = spark.range(series).select(F.concat(F.lit("s"), "id").alias("series_id")) if isinstance(series, int) else series
    a_day = 1440 // minutes
    whole = names.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_day")).repartition("series_id", "_day")  # days spread, few as the names may be
    rows = whole.select("series_id", F.explode(F.sequence(F.col("_day") * a_day, (F.col("_day") + 1) * a_day - 1)).alias("k"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(first).cast("timestamp")) + F.col("k") * 60 * minutes))
    day, part = F.floor(F.col("k") * minutes / 1440), F.pmod(F.col("k") * minutes, F.lit(1440)) / 1440.0
    smooth = lambda salt: noise(F.col("series_id"), day, salt) * (1 - part) + noise(F.col("series_id"), day + 1, salt) * part
    year, clock = F.dayofyear("ts") * (2 * 3.141592653589793 / 365), part * (2 * 3.141592653589793)
    clear = 0.6 + 0.4 * noise(F.col("series_id"), day, 3)
    return rows.select(
        "series_id",
        "ts",
        (9.5 - 11 * F.cos(year - 0.35) - 4 * F.cos(clock - 0.8) + 6 * smooth(1) + 2 * smooth(2)).alias("temp"),
        (S.clear_sky(F.col("ts")) * clear).alias("sun"),
        (2 + 1.5 * smooth(4)).alias("wind"),
    )


def load_series(spark: SparkSession, first: str, last: str, days: int, series: int | DataFrame = 1, minutes: int = 15, sd: float = 4.0, truth: dict | None = None) -> DataFrame:
    """The weather with calendar columns and a load made of known components plus noise."""
    t = TRUTH | (truth or {})
    rows = K.with_calendar(weather(spark, first, days, series, minutes), K.date_dimension(spark, first, last))
    rows = rows.withColumn("dark", S.darkness_of_slot(F.col("ts"))).withColumn("gloom", S.gloom(F.col("dark"), F.col("sun")))
    hours = minutes / 60
    rows = ema_many(rows, [(SIGNALS[x], t[tau], f"{x}_{m}") for m, tau in (("h", "tau"), ("c", "tau_c")) for x in ("temp", "sun", "wind")], hours)
    day = F.datediff("date_local", F.lit(first))
    clock = F.col("tod") * (2 * 3.141592653589793 / 24)
    base = 500 + 0.01 * day - 60 * F.cos(clock) - 30 * F.cos(2 * clock - 1) + F.when(F.col("daytype") >= 2, -40 + 10 * F.cos(clock)).otherwise(0.0) + 25 * F.col("dark") * F.when(F.col("tod").between(15, 23), F.pow(F.sin((F.col("tod") - 15) * (3.141592653589793 / 8)), 2)).otherwise(0.0)
    heating = (4 + 0.5 * F.cos(clock)) * P.heating_shape(F.col("temp"), star("h", t["a"], t["b"], t["w"]), t["t_b"], t["s"], t["alpha"])
    cooling = (3 + 1.0 * F.sin(clock - 2)) * P.cooling_shape(F.col("temp"), star("c", t["a_c"], 0.0, t["w_c"]), t["t_bc"], t["s_c"], t["alpha_c"])
    pv = (0.03 + 0.00003 * day) * F.col("sun") * P.pv_efficiency(F.col("temp"), t["gamma"])
    near_normal = (noise(F.col("series_id"), F.unix_timestamp("ts"), 7) + noise(F.col("series_id"), F.unix_timestamp("ts"), 8) + noise(F.col("series_id"), F.unix_timestamp("ts"), 9)) * sd
    made = rows.withColumns({"true_base": base, "true_heating": heating, "true_cooling": cooling, "true_pv": pv})
    return made.withColumn("load", F.col("true_base") + F.col("true_heating") + F.col("true_cooling") - F.col("true_pv") + near_normal).drop(*(f"{x}_{m}" for x in ("temp", "sun", "wind") for m in "hc"))
