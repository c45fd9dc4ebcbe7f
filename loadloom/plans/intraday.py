"""Intraday forecasts by horizon: features of the residuals known at each issue, and corrections learned from issues that have come true."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import arrays as A
from loadloom.operators.aggregates import scores
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import fit as M
from loadloom.plans.chunks import DAYS, FIELDS, FORECAST, WEATHER
from loadloom.plans.correction import correct_intraday, horizon_coefficients
from loadloom.plans.design import NAMES, Layout, Rows

FEATURES = ["x1", "xday", "yest", "week"]
#: The same of the error that forecast weather makes in the model.
WEATHER_FEATURES = [f"{f}_w" for f in FEATURES]


def known_at(rows: DataFrame, slots_a_day: int, ahead: int = 0, by: list[str] | None = None) -> DataFrame:
    """For each row position: means of the last few and of the last day's residuals before it (with ``ahead`` 1, up to it)."""
    w = Window.partitionBy(*(by or [SERIES])).orderBy("k")
    last = C.CORRECTION["last"]
    over = lambda n: w.rowsBetween(ahead - n, ahead - 1)
    mean = lambda n: F.when(F.count("r").over(over(n)) >= n // 2, F.avg("r").over(over(n)))
    return rows.withColumns({"x1": mean(last), "xday": mean(slots_a_day)})


def slot_means(rows: DataFrame, slots_a_day: int, by: list[str] | None = None) -> DataFrame:
    """series_id, back, yest, week: for each row, the mean residual of the hour that ends there, and its mean over 7 days to there."""
    by = by or [SERIES]
    w = Window.partitionBy(*by).orderBy("k")
    hour = max(slots_a_day // 24, 1)
    slot = Window.partitionBy(*by, F.pmod("k", F.lit(slots_a_day))).orderBy("k").rowsBetween(-6, 0)
    past = rows.withColumn("yest", F.avg("r").over(w.rowsBetween(-(hour - 1), 0))).withColumn("week", F.avg("yest").over(slot))
    return past.select(*by, F.col("k").alias("back"), "yest", "week")


def cube(predicted: DataFrame, horizons: list[int], slots_a_day: int = C.SLOTS_A_DAY, every: int = 1) -> DataFrame:
    """series_id, h, s, actual, pred and the features of every issue and horizon.

    ``predicted``: series_id, ts, load, model on a regular axis. The target of issue s at horizon h is row s + h. ``yest`` is the mean
    residual of the hour that ends at the target's slot on the last day known at s, ``week`` its mean over 7 such days: both are
    columns of an earlier row, met by an equality join, so the cube grows with issues times horizons and nothing else.
    """
    step = 86400 // slots_a_day
    rows = predicted.select(SERIES, (F.unix_timestamp("ts") / step).cast("long").alias("k"), F.col("load").alias("actual"), F.col("model").alias("pred"), (F.col("load") - F.col("model")).alias("r"))
    past = slot_means(rows, slots_a_day)
    issues = known_at(rows, slots_a_day).filter(F.pmod("k", F.lit(every)) == 0).select(SERIES, F.col("k").alias("s"), "x1", "xday")
    laid = issues.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    laid = laid.withColumn("k", F.col("s") + F.col("h")).withColumn("back", F.col("k") - slots_a_day * (F.floor(F.col("h") / slots_a_day) + 1))
    return laid.join(rows.select(SERIES, "k", "actual", "pred"), [SERIES, "k"]).join(past, [SERIES, "back"]).select(SERIES, "h", "s", "actual", "pred", *FEATURES)


def daily(fitted: DataFrame) -> DataFrame:
    """Coefficients of several cuts of a series (``fit.refits``: series_id, span, theta, coef, until) as folds, each in force from its cut until
    the series' next one, the last for a day. Of rows with the same cut, all but the least coefficients go."""
    one = fitted.groupBy(SERIES, "until").agg(F.min(F.struct("span", "theta", "coef")).alias("_p"))
    end = F.coalesce(F.lead("until").over(Window.partitionBy(SERIES).orderBy("until")), F.col("until") + 86400)
    return one.select(SERIES, F.col("until").cast("string").alias("fold"), "_p.*", F.col("until").alias("valid_from"), end.alias("valid_to"))


def in_force(params: DataFrame) -> DataFrame:
    """series_id, fold, span, theta, coef, valid_from, valid_to (seconds): parameters without instants are in force at every issue."""
    if "valid_from" not in params.columns:
        params = params.withColumns({"fold": F.lit(""), "valid_from": F.lit(-M.FAR), "valid_to": F.lit(M.FAR)})
    return params.select(SERIES, "fold", "span", "theta", "coef", "valid_from", "valid_to")


def remade(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, horizons: list[int]) -> DataFrame:
    """The model's prediction for every issue and horizon with the weather that the issue knows: measured before it, forecast from it on.

    series_id, fold, h, s (issue number), actual, pred. ``chunks`` hold the forecasts; where there is none, the measured value stands. Filters
    are linear, so an issue's filter is the forecast's plus the decayed gap between the measured and the forecast's at the issue: no filter is
    run again for an issue. ``params`` of ``daily`` give each issue the coefficients in force at it; issues without any have no row.
    """
    step, reach = int(step_hours * 3600), max(horizons) + 1
    own, one = in_force(params), F.struct("fold", "span", "theta", "coef", "valid_from", "valid_to")
    before = [f"before_{x}" for x in (*WEATHER, *FORECAST[: len(WEATHER)])]
    rows = chunks.select(SERIES, "chunk", *FIELDS, *FORECAST, *before)
    if "valid_from" in params.columns:  # a chunk needs the folds whose issues have targets in it, not those of the whole history
        number = lambda t: F.floor(t / (86400 * DAYS)).cast("int")
        touched = F.explode(F.sequence(number(F.col("valid_from")), number(F.col("valid_to") + reach * step))).alias("chunk")
        rows = rows.join(own.select("*", touched).groupBy(SERIES, "chunk").agg(F.sort_array(F.collect_list(one)).alias("folds")), [SERIES, "chunk"])
    else:
        rows = rows.join(own.groupBy(SERIES).agg(F.collect_list(one).alias("folds")), SERIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fields = M.read_chunk(batch, i) | {b: batch.column(b)[i].values.to_numpy(zero_copy_only=False) for b in before}
                name, first = batch.column(SERIES)[i].as_py(), int(fields["t"][0]) // step
                for fold, h, s, actual, pred in predictions(fields, layout, batch.column("folds")[i].as_py(), step_hours, horizons):
                    columns = [pa.array([name] * len(h)), pa.array([fold] * len(h)), pa.array(h, pa.int32()), pa.array(first + s, pa.int64()), pa.array(actual, from_pandas=True), pa.array(pred, from_pandas=True)]
                    made = pa.RecordBatch.from_arrays(columns, names=[SERIES, "fold", "h", "s", "actual", "pred"])
                    yield from (made.slice(k, 1 << 16) for k in range(0, len(h), 1 << 16))

    return rows.mapInArrow(run, f"{SERIES} string, fold string, h int, s long, actual double, pred double")


def spliced_ahead(fields: dict) -> dict[str, np.ndarray]:
    """The weather that forecasts tell, with that of the rows before the chunk; measured where there is no forecast."""
    told = {}
    for x in WEATHER:
        past, ahead, lately = fields[f"before_{x}"].copy(), fields[f"forecast_{x}"], fields[f"before_forecast_{x}"]
        if len(lately):
            past[-len(lately) :] = np.where(np.isnan(lately), past[-len(lately) :], lately)
        told[x] = np.concatenate([past, np.where(np.isnan(ahead), fields[x], ahead)])
    return told


def predictions(fields: dict, layout: Layout, folds: list[dict], step_hours: float, horizons: list[int]) -> Iterator[tuple]:
    """For the targets of one chunk and each fold: fold, horizon, issue (rows from the chunk's first), load and prediction. What doesn't depend on
    a fold is built once, and a fold's parts only over the rows that its issues reach."""
    n, at, step = len(fields["t"]), len(fields["before_temp"]), int(step_hours * 3600)
    measured, told = Rows(fields, layout).signals(), spliced_ahead(fields)
    now = {x: told[x][at:] for x in WEATHER}
    told = told | {"wind": told["wind"] * np.maximum(C.HEATING["inside"] - told["temp"], 0.0)}
    gloom = np.where(np.isnan(fields["forecast_gloom"]), fields["gloom"], fields["forecast_gloom"])
    seen, built, smooth = {**fields, **now, "gloom": gloom}, {}, {}

    def filtered(a: float, b: float, decay: float) -> tuple[np.ndarray, ...]:
        """What a house feels under the forecasts, its filter, and how far the filter of the measured weather is off that."""
        if (a, b, decay) not in smooth:
            felt, true = (v["temp"] + a * v["sun"] - b * v["wind"] for v in (told, measured))
            ahead = A.smoothed(felt, decay)
            smooth[a, b, decay] = felt[at:], ahead[at:], A.smoothed(true, decay) - ahead
        return smooth[a, b, decay]

    for fold in folds:
        low, high = (min(max(-(-(fold[v] - int(fields["t"][0])) // step), -at - n), n) for v in ("valid_from", "valid_to"))
        first, last = max(low + min(horizons), 0), min(high + max(horizons), n)  # rows that are targets of its issues
        if first >= last:
            continue
        q, coef, some = dict(zip(NAMES, fold["theta"], strict=True)), np.array(fold["coef"]), slice(first, last)
        future = Rows(seen, replace(layout, span_days=fold["span"]), built)
        s, k, t = future.layout.slices, future.k_shape()[some], now["temp"][some]
        ramps, trend = (future.once((x, fold["span"]), getattr(future, x))[some] for x in ("ramps", "trend"))
        level = future.once(("level", fold["span"]), lambda future=future, fold=fold: A.level_basis(future.days, fold["span"]))
        base = sum(x[some] @ coef[s[name]] for name, x in ({**future.once("blocks", future._fixed_blocks), "level": level}).items())
        still = base - ramps @ coef[s["pv"]] * now["sun"][some] * (1 - q["gamma"] * (t - C.PV["reference"]))
        heat = (k @ coef[s["heating"]] + trend @ coef[s["trend"]]) / np.maximum(1 + q["alpha"] * t, C.HEATING["cop_floor"])
        cool = k @ coef[s["cooling"]] / np.maximum(1 - q["alpha_c"] * (t - C.COOLING["reference"]), C.COOLING["eer_floor"])
        decay_h, decay_c = (float(np.exp(-step_hours / q[tau])) for tau in ("tau", "tau_c"))
        parts = ((q["w"], decay_h, filtered(q["a"], q["b"], decay_h)), (q["w_c"], decay_c, filtered(q["a_c"], 0.0, decay_c)))
        out = []
        for h in horizons:
            target = np.arange(max(low + h, h + 1 - at, 0), min(high + h, n))  # the issue lies in the rows that are held
            if not len(target):
                continue
            warm, cold = (w * felt[target] + (1 - w) * (ahead[target] + decay ** (h + 1) * gap[at + target - h - 1]) for w, decay, (felt, ahead, gap) in parts)
            i = target - first
            pred = still[i] + heat[i] * A.softplus(q["t_b"] - warm, q["s"]) + cool[i] * A.softplus(cold - q["t_bc"], q["s_c"])
            out.append((np.full(len(target), h), target - h, fields["load"][target], pred))
        if out:
            yield fold["fold"], *(np.concatenate([x[i] for x in out]) for i in range(4))


def remade_cube(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, horizons: list[int]) -> DataFrame:
    """The cube of issues and horizons with predictions as remade at each issue, and the features of two series known at it: the residuals
    under measured weather, and what forecast weather would have changed in the model. Both are those of the coefficients in force at the
    issue, over the days before it that features reach back to."""
    a_day = int(round(24 / step_hours))
    step = 86400 // a_day
    wide, by = in_force(params).withColumn("until", F.lit(M.FAR)), [SERIES, "fold"]
    if "valid_from" in params.columns:
        # as far back as a week's slots of the farthest target; a day more on either side, as days are local
        day = lambda c, n: (F.floor(F.col(c) / 86400) + n).cast("int")
        wide = wide.withColumns({"first": day("valid_from", -9), "last": day("valid_to", 1)})
    else:
        wide = wide.withColumns({"first": F.lit(-(10**6)), "last": F.lit(10**6)})
    number = (F.unix_timestamp("ts") / step).cast("long").alias("k")
    told_by = lambda p: M.predict(chunks, p, layout, step_hours, ahead=True, few_days="valid_from" in params.columns)
    known = told_by(wide).select(*by, number, (F.col("load") - F.col("model")).alias("r"), F.col("model").alias("_m"))
    told = told_by(wide.withColumn("until", F.lit(-M.FAR))).select(*by, number, F.col("model").alias("_f"))
    both = known.join(told, [*by, "k"])
    laid = remade(chunks, params, layout, step_hours, horizons)
    laid = laid.withColumn("back", F.col("s") + F.col("h") - a_day * (F.floor(F.col("h") / a_day) + 1))
    for tail, series in (("", both.select(*by, "k", "r")), ("_w", both.select(*by, "k", (F.col("_m") - F.col("_f")).alias("r")))):
        at_issue = known_at(series, a_day, by=by).select(*by, F.col("k").alias("s"), F.col("x1").alias(f"x1{tail}"), F.col("xday").alias(f"xday{tail}"))
        past = slot_means(series, a_day, by=by).select(*by, "back", F.col("yest").alias(f"yest{tail}"), F.col("week").alias(f"week{tail}"))
        laid = laid.join(at_issue, [*by, "s"]).join(past, [*by, "back"])
    return laid.select(SERIES, "h", "s", "actual", "pred", *FEATURES, *WEATHER_FEATURES)


def backtest_remade(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, horizons: list[int]) -> DataFrame:
    """Every issue and horizon with its corrected forecast, under forecast weather."""
    return correct_intraday(remade_cube(chunks, params, layout, step_hours, horizons), [*FEATURES, *WEATHER_FEATURES])


def backtest(predicted: DataFrame, horizons: list[int], slots_a_day: int = C.SLOTS_A_DAY, every: int = 1) -> DataFrame:
    """Every issue and horizon with its corrected forecast. Issues must be a regular series: ``every`` divides the horizons' delay."""
    return correct_intraday(cube(predicted, horizons, slots_a_day, every), FEATURES)


def coefficients(found: DataFrame) -> DataFrame:
    """series_id, h and the coefficient of each feature, from all issues whose target is known: what a forecast from the end of the data
    corrects with."""
    return horizon_coefficients(found, FEATURES)


def by_horizon(found: DataFrame) -> DataFrame:
    """Scores of the model and of the correction for each horizon, over the rows that have both."""
    both = found.filter("corrected is not null")
    model = scores(both, "actual", "pred", [SERIES, "h"])
    better = scores(both, "actual", "corrected", [SERIES, "h"])
    named = better.select(SERIES, "h", *(F.col(c).alias(f"{c}_corrected") for c in better.columns if c not in (SERIES, "h", "n")))
    return model.join(named, [SERIES, "h"])
