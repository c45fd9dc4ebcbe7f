"""Climatology, weather scenarios, uncertainty bands and monthly summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES, doy_slot, fill, local_parts
from loadloom.operators.windows import circular_mean


def climatology_cells(df: DataFrame, values: list[str]) -> DataFrame:
    """Mean of each day of the year and UTC slot that occurs, on a dense grid of the days that occur."""
    doy, slot = doy_slot(F.col("ts"))
    means = df.groupBy(SERIES, doy.alias("doy"), slot.cast("int").alias("slot")).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))
    days = means.select(SERIES, "doy").distinct().select(SERIES, "doy", F.explode(F.sequence(F.lit(0), F.lit(C.SLOTS_A_DAY - 1))).alias("slot"))
    return days.join(means, [SERIES, "doy", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def climatology(df: DataFrame, values: list[str], reach: int = 7) -> DataFrame:
    """(doy, slot) means, gaps filled along the day, smoothed over neighbouring days of the circular year."""
    cells = climatology_cells(df, values)
    out = None
    for v in values:
        whole = fill(cells.select(SERIES, "doy", "slot", v), v, limit=None, both=True, by=[SERIES, "doy"], order="slot", step=1)
        smooth = circular_mean(whole, v, "doy", 365, reach, [SERIES, "slot"], v)
        out = smooth if out is None else out.join(smooth, [SERIES, "slot", "doy"])
    return out


def fill_normal(df: DataFrame, normal: DataFrame, values: list[str]) -> DataFrame:
    """Missing values take the climatology of their day and slot."""
    doy, slot = doy_slot(F.col("ts"))
    named = normal.select(SERIES, "doy", "slot", *(F.col(v).alias(f"_{v}") for v in values))
    rows = df.withColumns({"doy": doy, "slot": slot.cast("int")}).join(named, [SERIES, "doy", "slot"], "left")
    return rows.withColumns({v: F.coalesce(v, f"_{v}") for v in values}).select(*df.columns)


def normal_weather(df: DataFrame, values: list[str], reach: int = 7) -> DataFrame:
    """Every value replaced by the climatology of its local day of the year and time of day; other columns stay."""
    rows = local_parts(df) if "tod" not in df.columns else df
    doy = F.least(F.dayofyear("date_local"), F.lit(365))
    means = rows.groupBy(SERIES, doy.alias("doy"), "tod").agg(*(F.avg(v).alias(v) for v in values))
    keyed = rows.withColumn("doy", doy)
    for v in values:
        smooth = circular_mean(means, v, "doy", 365, reach, [SERIES, "tod"], f"_{v}")
        keyed = keyed.drop(v).join(smooth, [SERIES, "tod", "doy"], "left").withColumnRenamed(f"_{v}", v)
    return keyed.select(*df.columns)


def scenario_shifts(df: DataFrame, horizon: DataFrame, years: int, offsets: tuple[int, ...] = (-14, -7, 0, 7, 14), coverage: float = 0.98) -> DataFrame:
    """Whole-year shifts, moved by some days, for which a series' history covers its horizon."""
    ends = df.groupBy(SERIES).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b")).join(horizon.groupBy(SERIES).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last")), SERIES)
    days = F.explode(F.array(*(F.lit(round(365.25 * k) + o) for k in range(1, years + 1) for o in offsets)))
    rows = ends.select("*", days.alias("shift"))
    first, last, back = F.unix_timestamp("_first"), F.unix_timestamp("_last"), F.col("shift") * 86400
    inside = F.least(last - back, F.unix_timestamp("_b")) - F.greatest(first - back, F.unix_timestamp("_a"))
    return rows.filter(inside > coverage * (last - first)).select(SERIES, "shift")


def scenarios(df: DataFrame, horizon: DataFrame, shifts: DataFrame, values: list[str], normal: DataFrame | None = None) -> DataFrame:
    """Weather of past years laid on the horizon, one scenario for each shift: an equality join on the shifted instant.

    With a climatology, temperature is anchored: the normal of the target replaces the normal of the source day.
    """
    source = df.select(SERIES, "ts", *values)
    if normal is not None and "temp" in values:
        doy, slot = doy_slot(F.col("ts"))
        named = normal.select(SERIES, "doy", "slot", F.col("temp").alias("_n"))
        with_normal = lambda x: x.withColumns({"doy": doy, "slot": slot.cast("int")}).join(named, [SERIES, "doy", "slot"], "left").drop("doy", "slot")
        source = with_normal(source).withColumn("temp", F.col("temp") - F.col("_n")).drop("_n")
        horizon = with_normal(horizon)
    laid = source.join(F.broadcast(shifts), SERIES).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("shift") * 86400))
    found = horizon.join(laid, [SERIES, "ts"])
    if "_n" in found.columns:
        found = found.withColumn("temp", F.col("temp") + F.col("_n")).drop("_n")
    return found


def band(df: DataFrame, value: str, model_sd: float | Column, least: int = 10, by: tuple[str, ...] = (SERIES, "ts")) -> DataFrame:
    """Mean and 80 % band over scenarios (their extremes where they are few), widened by the model's own error; ``low_weather`` and
    ``high_weather`` are the band without it. ``model_sd`` may be a column of ``by``."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    found = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), q.alias("_q"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    few, sd = F.col("n") < least, model_sd if isinstance(model_sd, Column) else F.lit(model_sd)
    found = found.withColumns({"low_weather": F.when(few, F.col("_min")).otherwise(F.col("_q")[0]), "high_weather": F.when(few, F.col("_max")).otherwise(F.col("_q")[1])})
    wide = lambda d: F.sqrt(d * d + F.pow(C.Z80 * sd, F.lit(2.0)))
    low, high = F.col("mean") - wide(F.col("mean") - F.col("low_weather")), F.col("mean") + wide(F.col("high_weather") - F.col("mean"))
    return found.select(*by, "n", "mean", low.alias("low"), high.alias("high"), "low_weather", "high_weather")


def monthly(df: DataFrame, value: str, zone: str | None = None) -> DataFrame:
    """Means of months over scenarios, and quantiles of the scenarios' monthly means: two small groupings."""
    ts = F.col("ts") if zone is None else F.from_utc_timestamp("ts", zone)
    each = df.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), "shift").agg(F.avg(value).alias("_v"))
    q = F.percentile("_v", F.array(F.lit(0.1), F.lit(0.9)))
    return each.groupBy("month").agg(F.avg("_v").alias("mean"), q.alias("_q")).select("month", "mean", F.col("_q")[0].alias("q10"), F.col("_q")[1].alias("q90"))
