"""Debiasing of forecasts and online corrections that read nothing a forecaster couldn't know."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES, local_parts


def debias(df: DataFrame, forecast: str, actual: str, cutoff: Column, days: int = 30, floor: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Subtract the mean error of each local hour over the days before the cutoff; a table of 24 rows a series is joined back."""
    by = [SERIES] if by is None else by
    rows = local_parts(df).withColumn("_h", F.floor("tod"))
    past = rows.filter((F.col("ts") < cutoff) & (F.col("ts") >= cutoff - F.expr(f"interval {days} days")))
    bias = past.groupBy(*by, "_h").agg(F.avg(F.col(forecast) - F.col(actual)).alias("_bias"))
    fixed = F.col(forecast) - F.coalesce("_bias", F.lit(0.0))
    fixed = fixed if floor is None else F.greatest(fixed, F.lit(floor))
    return rows.join(bias, [*by, "_h"], "left").withColumn(forecast, fixed).select(*df.columns)


def bias_history(df: DataFrame, forecast: str, actual: str, days: int = 30, least: int = 7, delay: int = 2) -> DataFrame:
    """For each local day and hour, the mean error over ``days`` days that ends ``delay`` days before; 0 where fewer than ``least``."""
    rows = local_parts(df).groupBy(SERIES, F.col("date_local").alias("d"), F.floor("tod").alias("h")).agg(F.avg(F.col(forecast) - F.col(actual)).alias("_e"))
    w = Window.partitionBy(SERIES, "h").orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-(days + delay - 1), -delay)
    return rows.withColumn("bias", F.when(F.count("_e").over(w) >= least, F.avg("_e").over(w)).otherwise(0.0)).drop("_e")


def online_slope(df: DataFrame, x: str, y: str, day: str, delay: int, ridge: float = C.CORRECTION["ridge"]) -> DataFrame:
    """Slope of y on x from the rows up to ``delay`` days before, lightly ridged."""
    w = Window.partitionBy(SERIES).orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -delay)
    xx, xy = F.sum(F.col(x) * F.col(x)).over(w), F.sum(F.col(x) * F.col(y)).over(w)
    return df.withColumn("slope", F.try_divide(xy, xx * (1 + ridge)))


def online(df: DataFrame, features: list[str], target: str, day: str, delay: int, warm_up: int, regular: Column | None = None, ridge: float = C.CORRECTION["ridge"]) -> DataFrame:
    """Ridge regression re-estimated for every day from the days at least ``delay`` before it; adds correction and coefficients.

    Moments are summed a day, then run up to the last known day; only one small row a day reaches the solver, which is
    given each row's own moments, so groups aren't collected. Days before ``warm_up`` known days get no correction.
    """
    known = F.lit(True) if regular is None else regular
    p = len(features)
    usable = known
    for c in (*features, target):
        usable = usable & F.col(c).isNotNull()
    names = [f"_g{i}{j}" for i in range(p) for j in range(i, p)] + [f"_c{i}" for i in range(p)]
    products = [F.col(features[i]) * F.col(features[j]) for i in range(p) for j in range(i, p)] + [F.col(f) * F.col(target) for f in features]
    moments = df.groupBy(SERIES, day).agg(*(F.sum(F.when(usable, x)).alias(n) for n, x in zip(names, products, strict=True)), F.max(usable.cast("int")).alias("_n"))
    w = Window.partitionBy(SERIES).orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -delay)
    run = moments.select(SERIES, day, *(F.sum(n).over(w).alias(n) for n in names), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n"))
    run = run.filter(F.col("_n") >= warm_up)

    def solve(batches):
        for pdf in batches:
            g, at = np.zeros((len(pdf), p, p)), 0
            for i in range(p):
                for j in range(i, p):
                    g[:, i, j] = g[:, j, i] = pdf[names[at]]
                    at += 1
            c = pdf[names[at : at + p]].to_numpy()
            trace = np.trace(g, axis1=1, axis2=2)
            g += (ridge * trace / p + 1e-300)[:, None, None] * np.eye(p)
            pdf["coef"] = list(np.linalg.solve(g, c[..., None])[..., 0])
            yield pdf[[SERIES, day, "coef"]]

    kind = df.schema[day].dataType.simpleString()
    coefs = run.mapInPandas(solve, f"{SERIES} string, {day} {kind}, coef array<double>")
    out = df.join(coefs, [SERIES, day], "left")
    total = F.lit(0.0)
    for i, f in enumerate(features):
        total = total + F.col("coef")[i] * F.col(f)
    return out.withColumn("correction", total).withColumns({f"coef_{f}": F.col("coef")[i] for i, f in enumerate(features)}).drop("coef")


def day_ahead_features(errors: DataFrame, dimension: DataFrame, cutoff_hour: float = 9.0) -> DataFrame:
    """For each slot of a target day T: x1 the mean error of T-2, x2 that of the morning of T-1, x3 the slot's deviation from the
    day mean over the last 7 regular days up to T-2 (at least 5). Irregular days give way to the last regular one.

    ``errors``: series_id, date_local, tod, error.
    """
    odd = F.broadcast(dimension.select(F.col("date").alias("date_local"), "irregular"))
    rows = errors.join(odd, "date_local", "left").withColumn("irregular", F.coalesce("irregular", F.lit(False)))
    day = rows.groupBy(SERIES, "date_local", "irregular").agg(F.avg("error").alias("mean"), F.avg(F.when(F.col("tod") < cutoff_hour, F.col("error"))).alias("morning"))
    w = Window.partitionBy(SERIES).orderBy("date_local").rowsBetween(Window.unboundedPreceding, 0)
    regular = lambda c: F.last(F.when(~F.col("irregular"), F.col(c)), True).over(w)
    day = day.withColumns({"last_mean": regular("mean"), "last_morning": regular("morning")})
    x1 = day.select(SERIES, F.date_add("date_local", 2).alias("date_local"), F.col("last_mean").alias("x1"))
    x2 = day.select(SERIES, F.date_add("date_local", 1).alias("date_local"), F.col("last_morning").alias("x2"))
    shape = rows.join(day.select(SERIES, "date_local", "mean"), [SERIES, "date_local"]).withColumn("dev", F.when(~F.col("irregular"), F.col("error") - F.col("mean")))
    k, least = C.CORRECTION["shape_days"], C.CORRECTION["shape_least"]
    # one row for each slot of a day, so that the hour which clocks repeat doesn't multiply what is joined on the slot
    regular_only = shape.filter("not irregular").groupBy(SERIES, "tod", "date_local").agg(F.avg("dev").alias("dev"))
    s = Window.partitionBy(SERIES, "tod").orderBy("date_local").rowsBetween(-(k - 1), 0)
    means = regular_only.select(SERIES, "tod", "date_local", F.when(F.count("dev").over(s) >= least, F.avg("dev").over(s)).alias("_m"))
    carried = Window.partitionBy(SERIES, "tod").orderBy("date_local").rowsBetween(Window.unboundedPreceding, 0)
    every = rows.select(SERIES, "tod", "date_local").distinct().join(means, [SERIES, "tod", "date_local"], "left").withColumn("x3", F.last("_m", True).over(carried))
    x3 = every.select(SERIES, "tod", F.date_add("date_local", 2).alias("date_local"), "x3")
    return rows.join(x1, [SERIES, "date_local"], "left").join(x2, [SERIES, "date_local"], "left").join(x3, [SERIES, "tod", "date_local"], "left")


def correct_day_ahead(errors: DataFrame, dimension: DataFrame) -> DataFrame:
    features = day_ahead_features(errors, dimension)
    return online(features, ["x1", "x2", "x3"], "error", "date_local", delay=2, warm_up=C.CORRECTION["warm_up"], regular=~F.col("irregular"))


def correct_intraday(cube: DataFrame, features: list[str], ridge: float = C.CORRECTION["ridge"]) -> DataFrame:
    """Per-horizon correction: at issue s and horizon h, the regression knows issues whose target had been measured, s - h - 1 and before.

    ``cube``: series_id, h, s (issue number), actual, pred and features. Running sums per (series, h); the delay varies with h, so
    the sums are joined to the row h + 1 issues later rather than framed.
    """
    p = len(features)
    err = F.col("actual") - F.col("pred")
    usable = err.isNotNull()
    for f in features:
        usable = usable & F.col(f).isNotNull()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = [f"_g{i}{j}" for i, j in pairs] + [f"_c{i}" for i in range(p)] + ["_n"]
    products = [F.col(features[i]) * F.col(features[j]) for i, j in pairs] + [F.col(f) * err for f in features] + [F.lit(1.0)]
    w = Window.partitionBy(SERIES, "h").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    run = cube.select(SERIES, "h", (F.col("s") + F.col("h") + 1).alias("s"), *(F.sum(F.when(usable, x)).over(w).alias(n) for n, x in zip(names, products, strict=True)))
    known = cube.join(run, [SERIES, "h", "s"])

    def solve(batches):
        for pdf in batches:
            g = np.zeros((len(pdf), p, p))
            for (i, j), n in zip(pairs, names, strict=False):
                g[:, i, j] = g[:, j, i] = pdf[n].fillna(0)
            c = pdf[names[len(pairs) : len(pairs) + p]].fillna(0).to_numpy()
            enough = pdf["_n"].fillna(0).to_numpy() >= C.CORRECTION["warm_up"]
            g += (ridge * np.trace(g, axis1=1, axis2=2) / p + 1e-12)[:, None, None] * np.eye(p)
            coef = np.linalg.solve(g, c[..., None])[..., 0]
            total = (coef * pdf[features].to_numpy()).sum(axis=1)
            pdf["corrected"] = np.where(enough & np.isfinite(total), pdf["pred"] + np.nan_to_num(total), np.nan)
            yield pdf[[SERIES, "h", "s", "actual", "pred", "corrected"]]

    schema = f"{SERIES} string, h int, s long, actual double, pred double, corrected double"
    found = known.withColumns({"h": F.col("h").cast("int"), "s": F.col("s").cast("long")}).mapInPandas(solve, schema)
    return found.withColumn("corrected", F.nanvl("corrected", F.lit(None).cast("double")))


def horizon_coefficients(cube: DataFrame, features: list[str], ridge: float = C.CORRECTION["ridge"]) -> DataFrame:
    """Ridge coefficients of each series and horizon from all its known rows; one small row of moments for each reaches the solver."""
    err, p = F.col("actual") - F.col("pred"), len(features)
    usable = err.isNotNull()
    for f in features:
        usable = usable & F.col(f).isNotNull()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g{i}{j}") for i, j in pairs] + [F.sum(F.col(f) * err).alias(f"c{i}") for i, f in enumerate(features)]
    moments = cube.filter(usable).groupBy(SERIES, F.col("h").cast("int").alias("h")).agg(*sums)

    def solve(batches):
        for pdf in batches:
            g = np.zeros((len(pdf), p, p))
            for i, j in pairs:
                g[:, i, j] = g[:, j, i] = pdf[f"g{i}{j}"]
            g += (ridge * np.trace(g, axis1=1, axis2=2) / p + 1e-12)[:, None, None] * np.eye(p)
            c = np.linalg.solve(g, pdf[[f"c{i}" for i in range(p)]].to_numpy()[..., None])[..., 0]
            out = pdf[[SERIES, "h"]].copy()
            for i, f in enumerate(features):
                out[f] = c[:, i]
            yield out

    return moments.mapInPandas(solve, f"{SERIES} string, h int, " + ", ".join(f"{f} double" for f in features))
