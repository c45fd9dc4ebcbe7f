"""The cleaned history as tables and files: what heating and cooling make of the load, by slot, month, year and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES

VALUES = ("actual", "cleaned", "heating", "cooling")


def history(predicted: DataFrame) -> DataFrame:
    """series_id, ts, local, date_local and the load, the load without heating and cooling, and these two. Slots without a load stay, with null
    where it would enter."""
    local = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(C.ZONE), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")
    rows = predicted.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("load", "heating", "cooling")})
    return rows.select(SERIES, "ts", local.alias("local"), "date_local", F.col("load").alias("actual"), (F.col("load") - F.col("heating") - F.col("cooling")).alias("cleaned"), "heating", "cooling")


def shares(rows: DataFrame, slots_a_day: int = C.SLOTS_A_DAY) -> DataFrame:
    """series_id, period (a month, a year, ``all``), the means of ``history``, heating and cooling in percent of the load, and days of slots.

    One shuffle of partial sums: a row counts for its three periods before it leaves its task. Only slots with a load and both parts count.
    """
    known = rows.filter(F.col("cleaned").isNotNull())
    period = F.explode(F.array(F.date_format("date_local", "yyyy-MM"), F.date_format("date_local", "yyyy"), F.lit("all")))
    means = known.select(SERIES, period.alias("period"), *VALUES).groupBy(SERIES, "period").agg(*(F.avg(c).alias(c) for c in VALUES), (F.count("*") / slots_a_day).alias("days"))
    share = lambda c: F.try_divide(100 * F.col(c), F.col("actual"))
    return means.withColumns({"share_heating": share("heating"), "share_cooling": share("cooling")})


def daily(rows: DataFrame, slots_a_day: int = C.SLOTS_A_DAY) -> DataFrame:
    """Means of each local day with at least 23 hours of known slots."""
    known = rows.filter(F.col("cleaned").isNotNull())
    means = known.groupBy(SERIES, "date_local").agg(*(F.avg(c).alias(c) for c in VALUES), F.count("*").alias("_n"))
    return means.filter(F.col("_n") * 24 >= 23 * slots_a_day).drop("_n")
