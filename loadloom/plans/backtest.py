"""Rolling and fold-wise validation. Weeks, issues and folds are keys beside the series, so all of them are fitted by the same jobs; the
history isn't copied for them: a chunk is read once and added to the sums of every fold that knows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.aggregates import scores
from loadloom.operators.timeaxis import SERIES, wall
from loadloom.plans import fit as M
from loadloom.plans.correction import correct_day_ahead
from loadloom.plans.design import Layout

#: Hour of the issue day before which rows are known.
KNOWN_UNTIL = 9
#: Hours from there to the end of the next day, where clocks go back.
HORIZON_HOURS = 40


def cutoff(day):
    return F.unix_timestamp(wall(day, KNOWN_UNTIL))


def shape_days(issues: DataFrame, every: int = C.REFIT["shape_days"]) -> DataFrame:
    """series_id, issue and the day whose shapes it uses: its series' first issue, then every ``every`` days, at or before the issue."""
    first = F.min("issue").over(Window.partitionBy(SERIES))
    return issues.withColumn("day", F.date_add(first, (F.floor(F.datediff("issue", first) / every) * every).cast("int")))


def span_of(day, layout: Layout):
    """Days of history that a fit on ``day`` has, which set the last knots of the level and the ramps."""
    return F.greatest(F.datediff(day, F.lit(layout.first)), F.lit(1))


def weekly_shapes(chunks: DataFrame, days: DataFrame, layout: Layout, step_hours: float, params: DataFrame | None = None, passes: int = 4) -> DataFrame:
    """Shapes of each series and day, fitted on the rows before 9:00 of that day only. ``days``: series_id, day.

    ``params`` (series_id, theta), from before the first day, gives the start; without, the default start.
    """
    folds = days.select(SERIES, "day").distinct()
    columns = {"fold": F.col("day").cast("string"), "span": span_of(F.col("day"), layout), "until": cutoff(F.col("day"))}
    if params is not None:
        folds = folds.join(params.select(SERIES, F.col("theta").alias("_theta")), SERIES)
        columns["theta"] = F.col("_theta")
    now = M.start(folds, layout, columns=columns)
    return M.joint(None, layout, step_hours, passes=passes, params=now, chunks=chunks)


def refitted(chunks: DataFrame, issues: DataFrame, shapes: DataFrame, layout: Layout, step_hours: float) -> DataFrame:
    """series_id, fold (the day of the shapes), span, until, theta, coef, rmse, n: for each issue day, coefficients from the rows before 9:00.

    ``issues``: series_id, issue (date), day. ``shapes``: series_id, fold (the day), span, theta. One scan gives the moments of all issues:
    those of a week share their shapes, and each sums what was known at it.
    """
    cuts = issues.groupBy(SERIES, F.col("day").cast("string").alias("fold")).agg(F.sort_array(F.collect_set(cutoff(F.col("issue")))).alias("_cuts"))
    known = shapes.select(SERIES, "fold", F.col("span").alias("_span"), F.col("theta").alias("_theta")).join(cuts, [SERIES, "fold"])
    weeks = M.start(known, layout, columns={"fold": F.col("fold"), "span": F.col("_span"), "theta": F.col("_theta"), "cuts": F.col("_cuts"), "until": F.array_max("_cuts")})
    return M.refits(chunks, weeks, layout, step_hours)


def rolling(chunks: DataFrame, issues: DataFrame, shapes: DataFrame, layout: Layout, step_hours: float) -> DataFrame:
    """Day-ahead forecasts: for each issue day, the coefficients of ``refitted``, then a prediction of all of the next day. Where the chunks hold
    forecast weather, it replaces the measured one from the cutoff on."""
    return day_ahead(chunks, issues, refitted(chunks, issues, shapes, layout, step_hours), layout, step_hours)


def horizon_bias(told: DataFrame, measured: DataFrame, issues: DataFrame, days: int = 30, kinds: tuple[str, ...] = ("temp", "wind")) -> DataFrame:
    """series_id, issue, and for each kind of weather an array ``bias_``: the mean error, over ``days`` days before the issue's cutoff, of the
    local hour that each of the hours after the cutoff is. Hours without a known error have 0.

    ``told`` and ``measured``: series_id, ts and the kinds. Issues stand among the errors as rows of the same windows, so each error is read
    once, however many issues look back at it.
    """
    both = told.select(SERIES, "ts", *kinds).join(measured.select(SERIES, "ts", *(F.col(x).alias(f"_{x}") for x in kinds)), [SERIES, "ts"])
    errors = both.select(SERIES, local_hour(F.col("ts")).alias("h"), F.unix_timestamp("ts").alias("t"), F.lit(None).cast("date").alias("issue"), *((F.col(x) - F.col(f"_{x}")).alias(x) for x in kinds))
    each_hour = F.explode(F.sequence(F.lit(0), F.lit(23)))
    marks = issues.select(SERIES, "issue").distinct().select(SERIES, each_hour.alias("h"), cutoff(F.col("issue")).alias("t"), "issue", *(F.lit(None).cast("double").alias(x) for x in kinds))
    w = Window.partitionBy(SERIES, "h").orderBy("t").rangeBetween(-days * 86400, -1)
    means = errors.unionByName(marks).select(SERIES, "h", "issue", *(F.coalesce(F.avg(x).over(w), F.lit(0.0)).alias(x) for x in kinds)).filter(F.col("issue").isNotNull())
    rings = means.groupBy(SERIES, "issue").agg(*(F.map_from_entries(F.collect_list(F.struct("h", x))).alias(x) for x in kinds))
    at = lambda x: F.transform(F.sequence(F.lit(0), F.lit(HORIZON_HOURS - 1)), lambda i: F.element_at(x, local_hour(F.timestamp_seconds(cutoff(F.col("issue")) + 3600 * i))))
    return rings.select(SERIES, "issue", *(at(F.col(x)).alias(f"bias_{x}") for x in kinds))


def local_hour(ts):
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(C.ZONE), ts.cast("timestamp_ntz")))


def day_ahead(chunks: DataFrame, issues: DataFrame, fitted: DataFrame, layout: Layout, step_hours: float, bias: DataFrame | None = None) -> DataFrame:
    """The forecasts of ``rolling``, from coefficients that there are. ``bias`` (of ``horizon_bias``) goes from the chunks' forecast weather."""
    ahead = issues.select(SERIES, F.col("day").cast("string").alias("fold"), cutoff(F.col("issue")).alias("until"), (F.datediff("issue", F.lit("1970-01-01")) + 1).alias("first"), F.col("issue").cast("string").alias("_issue"))
    each = fitted.join(ahead, [SERIES, "fold", "until"]).select(SERIES, F.col("_issue").alias("fold"), "span", "theta", "coef", "until", "first", F.col("first").alias("last"))
    if bias is not None:
        each = each.join(bias.withColumn("fold", F.col("issue").cast("string")).drop("issue"), [SERIES, "fold"], "left")
    told = M.predict(chunks, each, layout, step_hours, ahead=True, few_days=True)
    return told.select(SERIES, F.to_date("fold").alias("issue"), "ts", "date_local", "tod", "load", "base", "heating", "cooling", "pv", "model", (F.col("load") - F.col("model")).alias("error"))


def corrected(backtest: DataFrame, dimension: DataFrame) -> DataFrame:
    """The backtest with the online day-ahead correction; without enough known days there is none."""
    found = correct_day_ahead(backtest, dimension)
    return found.withColumn("corrected", F.col("model") + F.coalesce("correction", F.lit(0.0)))


def report(backtest: DataFrame, predicted: str = "model") -> DataFrame:
    """Scores of each month and of the whole."""
    rows = backtest.withColumn("month", F.explode(F.array(F.date_format("date_local", "yyyy-MM"), F.lit("all"))))
    return scores(rows, "load", predicted, [SERIES, "month"])


def left_out(chunks: DataFrame, layout: Layout, step_hours: float, folds: DataFrame, passes: int = 4) -> DataFrame:
    """Out-of-sample errors of folds (series_id, fold, first, last, forward): fitted without the rows from first to last, or, ``forward``,
    with those before first only; scored on the rows from first to last."""
    days = lambda c: F.datediff(c, F.lit("1970-01-01"))
    until = F.when(F.col("forward"), cutoff(F.col("first"))).otherwise(F.lit(M.FAR))
    span = F.when(F.col("forward"), span_of(F.col("first"), layout)).otherwise(F.lit(layout.span_days))
    columns = {"fold": F.col("fold"), "span": span, "until": until, "skip_first": days("first"), "skip_last": days("last")}
    params = M.from_scratch(None, layout, step_hours, passes=passes, params=M.start(folds, layout, columns=columns), chunks=chunks)
    tested = params.select(SERIES, "fold", "span", "theta", "coef", F.lit(M.FAR).alias("until"), F.col("skip_first").alias("first"), F.col("skip_last").alias("last"))
    return scores(M.predict(chunks, tested, layout, step_hours, ahead=True), "load", "model", [SERIES, "fold"])
