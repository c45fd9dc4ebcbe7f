"""One-year-ahead forecasts: weather scenarios, trends that hold or go on, and bands."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import arrays as A
from loadloom.functions import solar as S
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import fit as M
from loadloom.plans import scenario as Z
from loadloom.plans.chunks import chunked
from loadloom.plans.design import Layout

#: Standard deviation of the model's own error, for hourly values and for monthly means.
SD_HOUR, SD_MONTH = 15.0, 8.0


#: Slow components that can go on: the level, the heating increment and the solar capacity.
SLOW = ("level", "heating", "pv")


def trend_weights(rule: str) -> dict[str, float]:
    """``last`` continues each slow component at its last year's rate, ``hold`` keeps it; ``heating:0.5,pv:0`` damps single ones of ``last``."""
    if rule in ("last", "hold"):
        return dict.fromkeys(SLOW, float(rule == "last"))
    found = {k: float(v) for k, v in (part.split(":") for part in rule.split(","))}
    if set(found) - set(SLOW):
        raise ValueError(f"not slow components: {sorted(set(found) - set(SLOW))}")
    return dict.fromkeys(SLOW, 1.0) | found


def last_full_ramp(span_days: float) -> float:
    """Where the last ramp that the span holds whole ends."""
    knot = float(C.PV["knot_days"])
    return max(knot * int((span_days - knot) / knot + 1e-9) + knot, knot) if span_days >= 2 * knot else float(span_days)


def rates(params: DataFrame, layout: Layout, rules: list[str]) -> DataFrame:
    """series_id, trend (the rule), and what each slow component changes a day: level, heating (an array over the daily shape) and pv, and
    where ramps end.

    The change over the last year of the fit (or over all of a shorter one) by its days; the capacity doesn't fall.
    """
    weights = {rule: trend_weights(rule) for rule in rules}

    def run(batches):
        for pdf in batches:
            out = []
            for series, span, coef in zip(pdf[SERIES], pdf["span"], pdf["coef"], strict=True):
                lay, coef = replace(layout, span_days=int(span)), np.array(coef, float)
                year = min(365.0, float(span))
                level = np.diff(A.level_basis(np.array([span - year, float(span)]), span) @ coef[lay.slices["level"]])[0] / year
                end = last_full_ramp(span)
                back = min(365.0, end)
                ramp = A.ramps(np.array([end - back, end]), span, lay.n_ramps)
                trend = coef[lay.slices["trend"]].reshape(-1, lay.n_ramps) if lay.n_ramps else np.zeros((1 + 2 * C.HEATING["trend_harmonics"], 0))
                heat = trend @ (ramp[1, 1:] - ramp[0, 1:]) / back
                pv = max(float(np.diff(ramp @ coef[lay.slices["pv"]])[0]), 0.0) / back
                for rule, w in weights.items():
                    out.append((series, rule, w["level"] * level, (w["heating"] * heat).tolist(), w["pv"] * pv, float(span), end))
            yield pd.DataFrame(out, columns=[SERIES, "trend", "level_rate", "heating_rate", "pv_rate", "_span", "_end"])

    return params.select(SERIES, "span", "coef").mapInPandas(run, f"{SERIES} string, trend string, level_rate double, heating_rate array<double>, pv_rate double, _span double, _end double")


def laid_out(history: DataFrame, horizon: DataFrame, weather: str, years: int, given: DataFrame | None) -> DataFrame:
    """The horizon under a kind of weather: one row for each instant and ``shift`` (0 but for scenarios)."""
    values = ["temp", "sun", "wind"]
    if weather == "given":
        return horizon.join(given.select(SERIES, "ts", *values), [SERIES, "ts"]).withColumn("shift", F.lit(0))
    normal = Z.climatology(history, values)
    if weather == "normal":
        return Z.fill_normal(horizon.withColumns({v: F.lit(None).cast("double") for v in values}), normal, values).withColumn("shift", F.lit(0))
    return Z.scenarios(history, horizon, Z.scenario_shifts(history, horizon, years), values, normal)


def predicted(history: DataFrame, horizon: DataFrame, params: DataFrame, layout: Layout, step_hours: float, weathers: list[str], years: int = 1, given: DataFrame | None = None) -> DataFrame:
    """series_id, weather, shift and ``predict``'s columns on the horizon, before any trend goes on. All kinds of weather and all scenarios are
    keys of one prediction. The last two months of a series' history precede each of them, so that filters start from the weather that was."""
    rows = None
    for weather in weathers:
        one = laid_out(history, horizon, weather, years, given).withColumn("weather", F.lit(weather))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("dark", S.darkness_of_slot(F.col("ts"))).withColumn("gloom", S.gloom(F.col("dark"), F.col("sun")))
    first = horizon.groupBy(SERIES).agg(F.min("ts").alias("_first"))
    before = history.join(first, SERIES).filter((F.col("ts") < F.col("_first")) & (F.col("ts") >= F.col("_first") - F.expr("interval 60 days"))).drop("_first")
    before = before.join(rows.select(SERIES, "weather", "shift").distinct(), SERIES)
    keyed = rows.unionByName(before, allowMissingColumns=True).withColumns({"_series": F.col(SERIES), SERIES: F.concat_ws("|", SERIES, "weather", F.col("shift").cast("string"))})
    chunks = chunked(keyed.drop("load"), "scenario-chunks")
    own = params.select(F.col(SERIES).alias("_series"), "span", "theta", "coef")
    ids = keyed.select(SERIES, "_series", "weather", "shift").distinct().join(first.withColumnRenamed(SERIES, "_series"), "_series")
    told = M.predict(chunks, ids.join(own, "_series").select(SERIES, F.lit("").alias("fold"), "span", "theta", "coef"), layout, step_hours)
    told = told.join(ids, SERIES).filter(F.col("ts") >= F.col("_first"))
    return told.drop(SERIES, "_first", "fold").withColumnRenamed("_series", SERIES)


def continued(told: DataFrame, rate: DataFrame, layout: Layout) -> DataFrame:
    """``predicted`` with its slow components gone on: series_id, weather, trend, shift, ts, the parts and their total ``pred``.

    Rates are a property of the fit, and the load that a unit of sensitivity or capacity makes is told, so a rule costs no prediction.
    """
    told = told.join(rate, [c for c in (SERIES, "trend") if c in told.columns])
    days = F.datediff("date_local", F.lit(layout.first)) + F.col("tod") / 24
    beyond, beyond_ramps = F.greatest(days - F.col("_span"), F.lit(0.0)), F.greatest(days - F.col("_end"), F.lit(0.0))
    angle = lambda k: F.col("tod") * (2 * math.pi * k / 24)
    harmonics = range(1, C.HEATING["trend_harmonics"] + 1)
    waves = [F.lit(1.0), *(F.cos(angle(k)) for k in harmonics), *(F.sin(angle(k)) for k in harmonics)]
    more = sum((F.col("heating_rate")[i] * w for i, w in enumerate(waves)), F.lit(0.0)) * beyond_ramps
    told = told.withColumns({
        "base": F.col("base") + F.col("level_rate") * beyond,
        "heating": F.col("heating") + more * F.col("heating_shape"),
        "pv": F.col("pv") + F.col("pv_rate") * beyond_ramps * F.col("pv_shape"),
    })
    return told.select(SERIES, "weather", "trend", "shift", "ts", "base", "heating", "cooling", "pv", (F.col("base") + F.col("heating") + F.col("cooling") - F.col("pv")).alias("pred"))


def forecast(history: DataFrame, horizon: DataFrame, params: DataFrame, layout: Layout, step_hours: float, weather: str = "scenarios", trend: str = "last", years: int = 1, given: DataFrame | None = None) -> DataFrame:
    """Components and total of each instant and scenario.

    ``horizon``: series_id, ts and calendar columns. ``weather``: ``scenarios`` (past years laid on the horizon, temperature anchored
    at the climatology), ``normal``, or ``given`` (that of the frame ``given``). ``trend``: see ``trend_weights``.
    """
    told = predicted(history, horizon, params, layout, step_hours, [weather], years, given)
    return continued(told, rates(params, layout, [trend]), layout).drop("weather", "trend")


CASE = [SERIES, "cutoff", "weather", "trend"]


def forward(rows: DataFrame, params: DataFrame, layout: Layout, step_hours: float, cases: list[tuple[str, str]], days: int = 365, years: int = 1) -> DataFrame:
    """series_id, cutoff, weather, trend, shift, ts, pred, load: for every cutoff ``days`` ahead from what was known at it, under every case of
    weather and trend (``given`` is the weather that came). Cutoffs, weather and scenarios are keys of one prediction.

    ``rows``: load, weather and calendar of the whole span. ``params``: series_id, cutoff (an instant), span, theta, coef.
    """
    cut = params.select(SERIES, F.col("cutoff")).withColumn("_key", F.concat_ws("@", SERIES, F.unix_timestamp("cutoff").cast("string")))
    each = rows.join(cut, SERIES).withColumns({"_series": F.col(SERIES), SERIES: F.col("_key")}).drop("_key")
    # (an instant doesn't depend on the zone of the session, so it is the key)
    known = each.filter(F.col("ts") < F.col("cutoff")).drop("cutoff", "_series")
    later = each.filter((F.col("ts") >= F.col("cutoff")) & (F.col("ts") < F.col("cutoff") + F.expr(f"interval {days} days")))
    horizon = later.drop("cutoff", "_series", "load", "temp", "sun", "wind", "dark", "gloom")
    own = params.join(cut, [SERIES, "cutoff"]).select(F.col("_key").alias(SERIES), "span", "theta", "coef")
    told = predicted(known, horizon, own, layout, step_hours, list(dict.fromkeys(w for w, _ in cases)), years, later)
    rules = F.array(*(F.struct(F.lit(w).alias("weather"), F.lit(t).alias("trend")) for w, t in cases))
    of_weather = F.transform(F.filter(rules, lambda x: x["weather"] == F.col("weather")), lambda x: x["trend"])
    found = continued(told.withColumn("trend", F.explode(of_weather)), rates(own, layout, list(dict.fromkeys(t for _, t in cases))), layout)
    truth = later.select(SERIES, "ts", F.col("_series").alias("_s"), "cutoff", "load")
    return found.join(truth, [SERIES, "ts"]).select(F.col("_s").alias(SERIES), "cutoff", "weather", "trend", "shift", "ts", "pred", "load")


def judged(found: DataFrame, reference: tuple[str, str] = ("given", "last")) -> DataFrame:
    """A row for each case of ``forward``: errors of the mean of its scenarios (rmse, mape, bias; monthly_bias, the root mean square of the months'
    means; volume_mape, of months), sd, and the shares of instants in the band of weather alone and in that with the model's error.

    ``sd`` is the error under ``reference`` (the weather that came) of the series' other cutoffs, so no band knows the year that it is held
    against; a series with one cutoff has none, and no coverage.
    """
    e = F.col("load") - F.col("pred")
    own = found.filter((F.col("weather") == reference[0]) & (F.col("trend") == reference[1])).groupBy(SERIES, "cutoff").agg(F.sum(e * e).alias("_e"), F.count(e).alias("_n"))
    w = Window.partitionBy(SERIES)
    sd = own.select(SERIES, "cutoff", F.sqrt(F.try_divide(F.sum("_e").over(w) - F.col("_e"), F.sum("_n").over(w) - F.col("_n"))).alias("sd"))
    rows = Z.band(found.join(sd, [SERIES, "cutoff"], "left"), "pred", F.col("sd"), by=(*CASE, "ts", "load", "sd")).filter(F.col("load").isNotNull())
    e = F.col("load") - F.col("mean")
    share = lambda low, high: F.sum((F.col("load") >= F.col(low)).cast("int") * (F.col("load") <= F.col(high)).cast("int"))
    month = rows.groupBy(*CASE, "sd", F.date_format("ts", "yyyy-MM").alias("_m")).agg(
        F.count("*").alias("_n"), F.sum(e).alias("_e"), F.sum(e * e).alias("_ee"), F.sum(F.abs(e / F.col("load"))).alias("_r"), F.sum("load").alias("_l"), F.max("n").alias("_s"),
        share("low", "high").alias("_in"), share("low_weather", "high_weather").alias("_inw"),
    )
    n, mean = F.sum("_n"), F.col("_e") / F.col("_n")
    return month.groupBy(*CASE, "sd").agg(
        n.alias("n"), F.max("_s").alias("scenarios"), F.sqrt(F.sum("_ee") / n).alias("rmse"), (100 * F.sum("_r") / n).alias("mape"), (F.sum("_e") / n).alias("bias"),
        F.sqrt(F.avg(mean * mean)).alias("monthly_bias"), (100 * F.avg(F.abs(F.col("_e") / F.col("_l")))).alias("volume_mape"),
        (F.sum("_inw") / n).alias("coverage_weather"), (F.sum("_in") / n).alias("coverage"),
    )


def summary(found: DataFrame) -> DataFrame:
    """The mean of the scenarios at each instant with its 80 % band."""
    return Z.band(found, "pred", SD_HOUR).drop("low_weather", "high_weather")
