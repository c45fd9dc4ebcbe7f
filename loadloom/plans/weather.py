"""Forecast weather: quarter-hourly temperature, wind, sunshine and gloom from hourly temperature, cloud cover and wind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import solar as S
from loadloom.functions.numeric import bilinear, bin_left
from loadloom.operators.aggregates import fill_cells, ratio_cells
from loadloom.operators.timeaxis import SERIES, hours_to_slots

N_CLOUD, N_SUN = len(C.CLOUD_EDGES) - 1, len(C.ELEVATION_EDGES) - 1
CLOUD_AT = [(a + b) / 2 for a, b in zip(C.CLOUD_EDGES, C.CLOUD_EDGES[1:], strict=False)]
SUN_AT = [(a + b) / 2 for a, b in zip(C.ELEVATION_EDGES, C.ELEVATION_EDGES[1:], strict=False)]


def binned(hours: DataFrame) -> DataFrame:
    """Hours with sun, in bins of cloud cover and sine of the sun's height. ``hours``: ts, cloud, sun."""
    middle = F.timestamp_seconds(F.unix_timestamp("ts") + 1800)
    rows = hours.withColumns({"clear": S.clear_sky(middle), "height": F.greatest(S.cos_zenith(middle), F.lit(0.0))})
    rows = rows.filter((F.col("clear") > C.CLEAR_LEAST) & F.col("cloud").isNotNull() & F.col("sun").isNotNull())
    return rows.withColumns({"cloud_bin": bin_left(F.col("cloud"), C.CLOUD_EDGES), "sun_bin": bin_left(F.col("height"), C.ELEVATION_EDGES)})


def calibrate(hours: DataFrame) -> DataFrame:
    """One row: ``kt``, the clearness of each cell (ratio of sums, thin cells filled), nested by cloud bin and height bin.

    Quantiles of clearness follow in ``kt_q``, ten for each cell; 70 cells whatever the history.
    """
    rows = binned(hours)
    cells = ratio_cells(rows, ["cloud_bin", "sun_bin"], "sun", "clear", [])
    alone = ratio_cells(rows, ["cloud_bin"], "sun", "clear", [])
    full = fill_cells(cells, alone, N_CLOUD, N_SUN, C.CELL_LEAST)
    q = F.percentile(F.col("sun") / F.col("clear"), F.array(*map(F.lit, C.KT_QUANTILES)))
    quantiles = rows.groupBy("cloud_bin", "sun_bin").agg(q.alias("q"))
    value = full.columns[-1]
    both = full.join(quantiles, ["cloud_bin", "sun_bin"], "left")
    per_cell = F.coalesce("q", F.array_repeat(F.col(value), len(C.KT_QUANTILES)))
    by_cloud = both.groupBy("cloud_bin").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sun_bin", F.col(value).alias("v")))), lambda x: x["v"]).alias("row"),
        F.transform(F.sort_array(F.collect_list(F.struct("sun_bin", per_cell.alias("q")))), lambda x: x["q"]).alias("row_q"),
    )
    return by_cloud.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cloud_bin", "row"))), lambda x: x["row"]).alias("kt"),
        F.transform(F.sort_array(F.collect_list(F.struct("cloud_bin", "row_q"))), lambda x: x["row_q"]).alias("kt_q"),
    )


def slots(archive: DataFrame, axis: DataFrame, table: DataFrame) -> DataFrame:
    """series_id, ts, temp, wind, sun, gloom on the quarter hours of ``axis``; the calibration (one row) is broadcast.

    Sunshine is the clear sky's times the clearness interpolated between bin centres; gloom is expected over the quantiles.
    """
    rows = hours_to_slots(archive, axis.select(SERIES, "ts"), ["temp", "cloud", "wind"])
    middle = S.shifted(F.col("ts"), 450)
    rows = rows.withColumns({"_clear": S.clear_sky(middle), "_height": F.greatest(S.cos_zenith(middle), F.lit(0.0)), "_dark": S.darkness_of_slot(F.col("ts"))})
    rows = rows.crossJoin(F.broadcast(table))  # a single row
    kt = bilinear(F.col("kt"), F.col("cloud"), F.col("_height"), CLOUD_AT, SUN_AT)
    place: Column = F.element_at(F.element_at("kt_q", bin_left(F.col("cloud"), C.CLOUD_EDGES) + 1), bin_left(F.col("_height"), C.ELEVATION_EDGES) + 1)
    light = F.aggregate(place, F.lit(0.0), lambda s, q: s + F.exp(-F.greatest(q * F.col("_clear"), F.lit(0.0)) / C.GLOOM_LIGHT)) / len(C.KT_QUANTILES)
    return rows.select(SERIES, "ts", "temp", "wind", (F.col("_clear") * kt).alias("sun"), ((1 - F.col("_dark")) * light).alias("gloom"))
