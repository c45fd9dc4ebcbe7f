"""Scores, calibration cells, regressions, moments, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom.operators.timeaxis import fill


def scores(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """n, RMSE, MAE, bias, RMSE without bias, MAPE (%) and R2; rows with a null in either are left out."""
    e, y = F.col(actual) - F.col(predicted), F.col(actual)
    known = df.filter(e.isNotNull())
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("rmse_unbiased"),
        (100 * F.avg(F.abs(F.try_divide(e, y)))).alias("mape"), (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("r2"),
    )


def ratio_cells(df: DataFrame, by: list[str], above: str, below: str, quantiles: list[float]) -> DataFrame:
    """Count, ratio of sums, and exact quantiles of the ratio in each cell."""
    found = [F.count("*").alias("n"), F.try_divide(F.sum(above), F.sum(below)).alias("kt")]
    if quantiles:
        found.append(F.percentile(F.col(above) / F.col(below), F.array(*map(F.lit, quantiles))).alias("kt_q"))
    return df.groupBy(*by).agg(*found)


def fill_cells(cells: DataFrame, alone: DataFrame, n_first: int, n_second: int, least: int) -> DataFrame:
    """A dense grid: cells of fewer than ``least`` rows are interpolated along the first bin, held at the ends; a second bin
    without any cell takes the value of the first bin alone."""
    a, b = cells.columns[:2]
    grid = cells.sparkSession.range(n_first * n_second).select((F.col("id") / n_second).cast("int").alias(a), (F.col("id") % n_second).cast("int").alias(b))
    dense = grid.join(cells, [a, b], "left").select(a, b, F.when(F.col("n") >= least, F.col("kt")).alias("kt"))
    lined = fill(dense, "kt", limit=None, both=True, by=[b], order=a, step=1)
    return lined.join(alone.select(a, F.col("kt").alias("_alone")), a, "left").select(a, b, F.coalesce("kt", "_alone").alias("kt"))


def regressions(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Slope, intercept and the slope's standard error for each group, from one pass of moments."""
    sxx, syy, sxy = (f(F.col(y), F.col(x)) for f in (F.regr_sxx, F.regr_syy, F.regr_sxy))
    se = F.sqrt((syy - sxy * sxy / sxx) / (F.count("*") - 2) / sxx)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), se.alias("slope_se"))


def gram_columns(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """All products of a few columns, summed: one row g_ij, c_i, n. Partial sums are merged before the shuffle."""
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]
    return df.agg(*pairs, *(F.sum(F.col(a) * F.col(y)).alias(f"c{i}") for i, a in enumerate(x)), F.count("*").alias("n"))


def profile_difference(df: DataFrame, value: str, by: list[str], before: Column, after: Column) -> DataFrame:
    v = F.col(value)
    pick = lambda side, f: f(F.when(side, v))
    effect = pick(after, F.avg) - pick(before, F.avg)
    se = F.sqrt(pick(after, F.var_samp) / pick(after, F.count) + pick(before, F.var_samp) / pick(before, F.count))
    return df.filter(before | after).groupBy(*by).agg(effect.alias("effect"), se.alias("se"))


def asof(left: DataFrame, right: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The right value of greatest ``order`` at or before each left row: both sides in one stream, the last known value carried on."""
    a = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*by, order, value).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, True).over(w))
    return both.filter("_side = 1").drop("_side")
