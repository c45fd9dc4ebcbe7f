"""Weather as it was foreseen at an instant of decision, and the forecast made with it.

Two times meet here: the target of a forecast and the instant at which it was issued. A decision (``series_id``, ``decided_at``) knows what was
measured before it, and of the archive's issues those up to it; nothing else enters, neither into the calibration nor into the bias or the
correction. All steps run over all decisions at once, with ``decided_at`` as a key beside the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import solar as S
from loadloom.functions.numeric import between, blended
from loadloom.operators.timeaxis import SERIES, fill, floor_to, hours_to_slots, local_parts, wall
from loadloom.plans import fit as M
from loadloom.plans import intraday as I
from loadloom.plans.chunks import BEFORE, DAYS, chunked
from loadloom.plans.correction import bias_history, debias
from loadloom.plans.design import Layout
from loadloom.plans.weather import CLOUD_AT, N_CLOUD, N_SUN, SUN_AT, binned
from loadloom.sources.store import materialised

DECIDED, ISSUED = "decided_at", "issued_at"
KEY = [SERIES, DECIDED]
#: Days of the bias, days before the decision with forecast weather beside the measured (for the correction), and quarter hours ahead.
BIAS_DAYS, PAST_DAYS, AHEAD = 30, 9, 156
PARTS = ("base", "heating", "cooling", "pv")
#: A decision's cell, or its cloud bin alone. Shares are counted in bins of 1/FINE, those beyond FINE_LAST bins in the outermost; any width gives
#: the same quantiles, a wider one has more rows to sort.
CELL = [*KEY, "cloud_bin", "sun_bin", "_alone"]
FINE, FINE_LAST = 256, 2**20


def issued_day_before(archive: DataFrame, hour: int = 10) -> DataFrame:
    """An archive without issue instants holds, for each local day, what was issued at ``hour`` of the day before."""
    day = local_parts(archive.select(SERIES, "ts").distinct()).select(SERIES, "ts", wall(F.date_sub("date_local", 1), hour).alias(ISSUED))
    return archive.join(day, [SERIES, "ts"])


def foreseen(archive: DataFrame, decisions: DataFrame, values: list[str], past: str, ahead: str) -> DataFrame:
    """series_id, decided_at, ts, issued_at and values: for each target from ``past`` before to ``ahead`` after a decision, the latest issue at
    or before both the decision and the target (an issue after its target is no forecast). Ties of the instant: the greatest values.

    A decision asks for whole days, an equality with the archive's; so a day's rows meet the decisions around it and no others.
    """
    first, end = F.col(DECIDED) - F.expr(f"interval {past}"), F.col(DECIDED) + F.expr(f"interval {ahead}")
    asked = decisions.select(*KEY, F.explode(F.sequence(F.to_date(first), F.to_date(end))).alias("_day"))
    told = archive.select(SERIES, "ts", ISSUED, *values, F.to_date("ts").alias("_day"))
    rows = asked.join(told, [SERIES, "_day"]).filter((F.col("ts") >= first) & (F.col("ts") < end) & (F.col(ISSUED) <= F.least(DECIDED, "ts")))
    latest = rows.groupBy(*KEY, "ts").agg(F.max(F.struct(ISSUED, *values)).alias("_r"))
    return latest.select(*KEY, "ts", "_r.*")


def in_time(archive: DataFrame, values: list[str]) -> DataFrame:
    """For each target the latest issue up to it: the history that calibrations read."""
    latest = archive.filter(F.col(ISSUED) <= F.col("ts")).groupBy(SERIES, "ts").agg(F.max(F.struct(ISSUED, *values)).alias("_r"))
    return latest.select(SERIES, "ts", "_r.*")


def issued_by(archive: DataFrame, values: list[str], hour: int = 10) -> DataFrame:
    """For each target the latest issue at or before ``hour`` of the local day before: one forecast a target, known to that day's issue and the next."""
    known = local_parts(archive).filter(F.col(ISSUED) <= wall(F.date_sub("date_local", 1), hour))
    latest = known.groupBy(SERIES, "ts").agg(F.max(F.struct(ISSUED, *values)).alias("_r"))
    return latest.select(SERIES, "ts", "_r.*")


def fine_bin(share: Column) -> Column:
    """The number of the bin, in the order of shares; NaN is the greatest, as Spark sorts it."""
    return F.when(share.isNotNull(), F.floor(F.least(F.greatest(share * FINE, F.lit(-float(FINE_LAST))), F.lit(float(FINE_LAST)))))


def places(quantiles: tuple[float, ...]) -> list[tuple[Column, Column, Column]]:
    """Each quantile's place among the ``_all`` sorted values, from 0, and the ranks around it."""
    at = [(F.col("_all") - 1) * F.lit(q) for q in quantiles]
    return [(x, F.floor(x), F.ceil(x)) for x in at]


def cell_counts(known: DataFrame, decided: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """For each decision and cell, and for each cloud bin alone (``_alone``, without ``sun_bin``): rows, sums, the number of shares (``_all``)
    and the bins in which the quantiles lie, with the number of shares before each."""
    bins = known.groupBy(SERIES, "_since", "cloud_bin", "sun_bin", "_fine").agg(F.count("*").alias("_n"), F.count("_share").alias("_m"), F.sum("sun").alias("_sun"), F.sum("clear").alias("_clear"))
    bins = bins.join(decided, SERIES).filter(F.col("_since") <= F.col(DECIDED)).withColumn("_alone", F.explode(F.array(F.lit(False), F.lit(True))))
    each = bins.withColumn("sun_bin", F.when(~F.col("_alone"), F.col("sun_bin"))).groupBy(*CELL, "_fine").agg(*(F.sum(c).alias(c) for c in ("_n", "_m", "_sun", "_clear")))
    line = Window.partitionBy(*CELL).orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumns({"_before": F.sum("_m").over(line) - F.col("_m"), "_all": F.sum("_m").over(Window.partitionBy(*CELL))})
    ranks = F.array(*(r for _, low, high in places(quantiles) for r in (low, high)))
    holds = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    bins_held = F.collect_list(F.when(holds, F.struct("_fine", "_before"))).alias("_bins")
    return placed.groupBy(*CELL, "_all").agg(*(F.sum(c).alias(c) for c in ("_n", "_sun", "_clear")), bins_held)


def cell_quantiles(known: DataFrame, found: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """``_q``, the quantiles of each cell that has shares: those at the ranks around each are looked up among the counted shares of their bin."""
    asked = found.select(*CELL, "_all", F.inline("_bins")).withColumnRenamed("sun_bin", "_height")
    near = known.join(asked, [SERIES, "cloud_bin", "_fine"]).filter((F.col("_since") <= F.col(DECIDED)) & (F.col("_alone") | (F.col("sun_bin") == F.col("_height"))))
    key = [*KEY, "cloud_bin", "_height", "_alone", "_all"]
    counted = near.groupBy(*key, "_fine", "_before", "_share").agg(F.count("*").alias("_m"))
    line = Window.partitionBy(*key, "_fine", "_before").orderBy("_share").rowsBetween(Window.unboundedPreceding, 0)
    laid = counted.withColumn("_to", F.col("_before") + F.sum("_m").over(line))
    at = lambda r: F.max(F.when((r >= F.col("_to") - F.col("_m")) & (r < F.col("_to")), F.col("_share")))
    values = laid.groupBy(*key).agg(*(at(r).alias(f"_{side}{j}") for j, (_, *around) in enumerate(places(quantiles)) for side, r in zip(("low", "high"), around, strict=True)))
    between_ranks = lambda a, b, x, low, high: F.when(a == b, a).otherwise((high - x) * a + (x - low) * b)
    q = F.array(*(between_ranks(F.col(f"_low{j}"), F.col(f"_high{j}"), *p) for j, p in enumerate(places(quantiles))))
    return values.select(*KEY, "cloud_bin", F.col("_height").alias("sun_bin"), "_alone", q.alias("_q"))


def cell_values(rows: DataFrame, decisions: DataFrame, n_cloud: int = N_CLOUD, n_sun: int = N_SUN, least: int = C.CELL_LEAST, quantiles: tuple[float, ...] = C.KT_QUANTILES) -> DataFrame:
    """series_id, decided_at, cloud_bin, sun_bin, i, v: each decision's calibration, dense. i 0 is the clearness (ratio of sums), the others
    its quantiles. ``rows``: series_id, ts, cloud_bin, sun_bin, sun, clear; those before the decision count.

    A cell of fewer than ``least`` rows is interpolated between its neighbours in cloud cover at the same height of the sun, held at the ends;
    a height without any full cell takes the values of the cloud bin alone (null where that has no rows either).

    Quantiles are exact and take two passes: one counts the rows by bins of their share, the other sorts the shares of those bins in which a
    quantile lies. A row counts for the first decision that knows it, and so for all later ones; no task holds the shares of a cell. Both passes
    run at once, and the result reads only what they wrote.
    """
    decided = decisions.select(*KEY).distinct()
    since = decided.select(SERIES, F.col(DECIDED).alias("_since"), F.lag(DECIDED).over(Window.partitionBy(SERIES).orderBy(DECIDED)).alias("_last"))
    share = F.col("sun") / F.col("clear")
    known = rows.join(since, SERIES).filter((F.col("ts") < F.col("_since")) & (F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))))
    known = known.select(SERIES, "_since", "cloud_bin", "sun_bin", "sun", "clear", share.alias("_share")).withColumn("_fine", fine_bin(F.col("_share")))
    found = materialised(cell_counts(known, decided, quantiles), "cell-counts")
    exact = materialised(cell_quantiles(known, found, quantiles), "cell-quantiles")
    ratio = F.array(F.try_divide("_sun", "_clear"))

    def valued(alone: bool, by: list[str], name: str) -> DataFrame:
        mine, its = (x.filter(F.col("_alone") == alone) for x in (found, exact))
        return mine.join(its.select(*by, "_q"), by, "left").select(*by, "_n", F.concat(ratio, F.coalesce("_q", F.array().cast("array<double>"))).alias(name))

    cells, alone = valued(False, [*KEY, "cloud_bin", "sun_bin"], "_own"), valued(True, [*KEY, "cloud_bin"], "_alone").drop("_n")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = decisions.select(*KEY, upto(n_cloud).alias("cloud_bin")).select("*", upto(n_sun).alias("sun_bin")).select("*", upto(len(quantiles) + 1).alias("i"))
    full = grid.join(cells.filter(F.col("_n") >= least), [*KEY, "cloud_bin", "sun_bin"], "left").withColumn("v", F.get("_own", F.col("i"))).drop("_own", "_n")
    lined = fill(full, "v", limit=None, both=True, by=[*KEY, "sun_bin", "i"], order="cloud_bin", step=1)
    return lined.join(alone, [*KEY, "cloud_bin"], "left").select(*KEY, "cloud_bin", "sun_bin", "i", F.coalesce("v", F.get("_alone", F.col("i"))).alias("v"))


def tables(cells: DataFrame) -> DataFrame:
    """series_id, decided_at, kt: the clearness and its quantiles as nested arrays, one of cloud and height bins for each."""
    flat = cells.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "cloud_bin", "sun_bin", "v"))).alias("_r"))
    row = lambda c: F.transform(F.filter("_r", c), lambda x: x["v"])
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    nested = F.transform(numbers(len(C.KT_QUANTILES) + 1), lambda i: F.transform(numbers(N_CLOUD), lambda c: row(lambda x: (x["i"] == i) & (x["cloud_bin"] == c))))
    return flat.select(*KEY, nested.alias("kt"))


def slots(hours: DataFrame, kt: DataFrame, past: str, ahead: str) -> DataFrame:
    """series_id, decided_at, ts, temp, wind, sun, gloom on quarter hours, from the hours foreseen at each decision and its calibration.

    Sunshine is the clear sky's times the clearness, gloom is expected over the quantiles of clearness; both tables are interpolated
    between the centres of their bins.
    """
    step = F.expr(f"interval {C.STEP_MINUTES} minutes")
    span = hours.groupBy(*KEY).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    first, last = F.greatest(floor_to(F.col(DECIDED) - F.expr(f"interval {past}"), C.STEP_MINUTES), F.col("_a")), F.least(F.col(DECIDED) + F.expr(f"interval {ahead}") - step, F.col("_b") + F.expr("interval 45 minutes"))
    axis = span.filter(first <= last).select(*KEY, F.explode(F.sequence(first, last, step)).alias("ts"))
    rows = hours_to_slots(hours, axis, ["temp", "cloud", "wind"], by=KEY)
    middle = S.shifted(F.col("ts"), 450)
    rows = rows.withColumns({"_clear": S.clear_sky(middle), "_height": F.greatest(S.cos_zenith(middle), F.lit(0.0)), "_dark": S.darkness_of_slot(F.col("ts"))}).join(kt, KEY)
    (i, p), (j, q) = between(F.col("cloud"), CLOUD_AT), between(F.col("_height"), SUN_AT)
    rows = rows.withColumns({"_i": i, "_p": p, "_j": j, "_q": q})
    rows = rows.withColumn("_kt", F.transform("kt", lambda t: blended(t, F.col("_i"), F.col("_p"), F.col("_j"), F.col("_q"))))
    n = len(C.KT_QUANTILES)
    light = F.aggregate(F.slice("_kt", 2, n), F.lit(0.0), lambda s, q: s + F.exp(-q * F.col("_clear") / C.GLOOM_LIGHT)) / n
    return rows.select(*KEY, "ts", "temp", "wind", (F.col("_clear") * F.get("_kt", F.lit(0))).alias("sun"), ((1 - F.col("_dark")) * light).alias("gloom"))


def day_ahead_weather(archive: DataFrame, measured: DataFrame, begun: DataFrame) -> DataFrame:
    """series_id, ts, temp, wind, sun, gloom on quarter hours: what day-ahead issues of a backtest read, over the whole archive. Clearness is
    calibrated on what was known when the backtest began, and gloom is its expectation. ``begun``: series_id, decided_at, one a series."""
    told = issued_by(archive, ["temp", "cloud", "wind"])
    sun = measured.groupBy(SERIES, floor_to(F.col("ts"), 60).alias("_h")).agg(F.avg("sun").alias("sun")).withColumnRenamed("_h", "ts")
    kt = tables(cell_values(binned(told.select(SERIES, "ts", "cloud").join(sun, [SERIES, "ts"])), begun))
    whole = "36500 days"  # slots end where the archive does
    return slots(told.join(begun.select(*KEY), SERIES), kt, whole, whole).drop(DECIDED)


def without_bias(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """Temperature and wind less the mean error of their local hour over ``BIAS_DAYS`` days. From the decision on these end with the decision; the
    days before it show the error of forecasts as of ``PAST_DAYS`` days ago, with what was known then. Older rows go."""
    own = measured.select(SERIES, "ts", F.col("temp").alias("_temp"), F.col("wind").alias("_wind"))
    both = rows.join(own, [SERIES, "ts"], "left")
    ago = F.col(DECIDED) - F.expr(f"interval {PAST_DAYS} days")

    def less(cutoff: Column, kept: Column) -> DataFrame:
        found = debias(debias(both, "temp", "_temp", cutoff, BIAS_DAYS, by=KEY), "wind", "_wind", cutoff, BIAS_DAYS, floor=0.0, by=KEY)
        return found.filter(kept).select(*rows.columns)

    return less(F.col(DECIDED), F.col("ts") >= F.col(DECIDED)).unionByName(less(ago, (F.col("ts") >= ago) & (F.col("ts") < F.col(DECIDED))))


def weather_at(archive: DataFrame, measured: DataFrame, decisions: DataFrame, horizon: int = AHEAD) -> DataFrame:
    """series_id, decided_at, ts, temp, wind, sun, gloom: from ``PAST_DAYS`` days before each decision to ``horizon`` quarter hours after it, the
    weather as foreseen at it. ``archive``: series_id, ts (hour), issued_at, temp, cloud, wind. ``measured``: series_id, ts, temp, sun, wind."""
    past, ahead, values = f"{PAST_DAYS + BIAS_DAYS} days", f"{horizon * C.STEP_MINUTES} minutes", ["temp", "cloud", "wind"]
    sun = measured.groupBy(SERIES, floor_to(F.col("ts"), 60).alias("_h")).agg(F.avg("sun").alias("sun")).withColumnRenamed("_h", "ts")
    history = in_time(archive, ["cloud"]).join(sun, [SERIES, "ts"])
    kt = tables(cell_values(binned(history), decisions))
    # an hour more on either side, so that slots at the ends lie between the middles of two hours where the archive has them
    hours = foreseen(archive, decisions, values, f"{PAST_DAYS + BIAS_DAYS} days 1 hours", f"{horizon * C.STEP_MINUTES + 60} minutes")
    return without_bias(slots(hours, kt, past, ahead), measured)


def named(df: DataFrame) -> DataFrame:
    """The series of one decision as a series of its own, for plans that know one key."""
    return df.withColumn(SERIES, F.concat_ws("@", SERIES, F.unix_micros(DECIDED).cast("string")))


def frames(rows: DataFrame, decisions: DataFrame, horizon: int = AHEAD) -> DataFrame:
    """The rows that a forecast from each decision needs: as many days before as filters remember, and the horizon. What is measured from the
    decision on is removed. Decisions ask for days, as in ``foreseen``."""
    first = F.date_sub(F.to_date(DECIDED), (BEFORE + 1) * DAYS)
    end = F.col(DECIDED) + F.expr(f"interval {horizon * C.STEP_MINUTES} minutes")
    asked = decisions.select(*KEY, F.explode(F.sequence(first, F.to_date(end))).alias("_day"))
    found = rows.withColumn("_day", F.to_date("ts")).join(asked, [SERIES, "_day"]).filter(F.col("ts") < end).drop("_day")
    past = F.col("ts") < F.col(DECIDED)
    return found.withColumns({c: F.when(past, F.col(c)) for c in ("load", "temp", "sun", "wind", "gloom")})


def unbroken(told: DataFrame) -> DataFrame:
    """series_id, decided_at, ts of the targets up to which no weather is missing: the filters need all of it."""
    ahead = told.filter((F.col("ts") >= F.col(DECIDED)) & F.col("temp").isNotNull() & F.col("sun").isNotNull() & F.col("wind").isNotNull())
    n = F.count("*").over(Window.partitionBy(*KEY).orderBy("ts"))
    step = 60 * C.STEP_MINUTES
    place = (F.unix_timestamp("ts") - F.unix_timestamp(DECIDED)) / step
    return ahead.select(*KEY, "ts", (n == F.floor(place) + 1).alias("_whole")).filter("_whole").drop("_whole")


def forecast(rows: DataFrame, archive: DataFrame, decisions: DataFrame, params: DataFrame, layout: Layout, coefs: DataFrame | None = None, horizon: int = AHEAD) -> DataFrame:
    """The forecast from each decision with the weather foreseen at it: series_id, decided_at, ts, h, the parts, model, correction, pred.

    ``rows``: quarter hours with calendar, load and weather of history and horizon (of which only the calendar is read from the decision on).
    ``params``: series_id, span, theta, coef, fitted on what was known at the decision. ``coefs``: series_id, h and a coefficient for each of
    the intraday features, also of the error that forecast weather makes (``correction_coefficients``); without, there is no correction.
    A target isn't forecast where forecast weather is missing between the decision and it.
    """
    decisions = decisions.select(*KEY).distinct()
    told = materialised(weather_at(archive, rows, decisions, horizon), "foreseen-weather")
    framed = frames(rows, decisions, horizon).join(unbroken(told).withColumn("_told", F.lit(True)), [*KEY, "ts"], "left")
    framed = framed.filter((F.col("ts") < F.col(DECIDED)) | F.col("_told")).drop("_told")
    chunks = chunked(named(framed), "foreseen-chunks", forecast=named(told))
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("fold"), u.alias("until")) for f, u in (("known", F.unix_timestamp(DECIDED)), ("told", F.lit(-M.FAR)))))).alias("_f")
    own = named(params.select(SERIES, "span", "theta", "coef").join(decisions, SERIES)).select(SERIES, "span", "theta", "coef", both)
    own = own.select(SERIES, "span", "theta", "coef", "_f.*", F.lit(-(10**6)).alias("first"), F.lit(10**6).alias("last"))
    step = 60 * C.STEP_MINUTES
    number = (F.unix_timestamp("ts") / step).cast("long")
    predicted = M.predict(chunks, own, layout, C.STEP_MINUTES / 60, ahead=True).select(SERIES, "fold", "ts", number.alias("k"), "load", *PARTS, F.nanvl("model", F.lit(None).cast("double")).alias("model"))
    predicted = materialised(predicted, "foreseen-predicted")
    known, alone = (predicted.filter(F.col("fold") == f) for f in ("known", "told"))
    ends = named(decisions.withColumn("_k", (F.unix_timestamp(DECIDED) / step).cast("long")).withColumn("_s", F.col(SERIES)))
    laid = known.join(ends, SERIES).filter((F.col("k") >= F.col("_k")) & F.col("model").isNotNull()).withColumn("h", (F.col("k") - F.col("_k")).cast("int"))
    if coefs is None:
        out = laid.withColumn("correction", F.lit(0.0))
    else:
        gap = known.join(alone.select(SERIES, "k", F.col("model").alias("_f")), [SERIES, "k"]).join(ends.select(SERIES, "_k"), SERIES).filter(F.col("k") < F.col("_k"))
        laid = laid.withColumn("back", F.col("k") - C.SLOTS_A_DAY * (F.floor(F.col("h") / C.SLOTS_A_DAY) + 1))
        for tail, r in (("", F.col("load") - F.col("model")), ("_w", F.col("model") - F.col("_f"))):
            series = gap.select(SERIES, "k", "_k", r.alias("r"))
            at = I.known_at(series, C.SLOTS_A_DAY, ahead=1).filter(F.col("k") == F.col("_k") - 1).select(SERIES, F.col("x1").alias(f"x1{tail}"), F.col("xday").alias(f"xday{tail}"))
            past = I.slot_means(series.select(SERIES, "k", "r"), C.SLOTS_A_DAY).select(SERIES, "back", F.col("yest").alias(f"yest{tail}"), F.col("week").alias(f"week{tail}"))
            laid = laid.join(at, SERIES, "left").join(past, [SERIES, "back"], "left")
        features = [f for f in (*I.FEATURES, *I.WEATHER_FEATURES) if f in coefs.columns]
        each = coefs.select(F.col(SERIES).alias("_s"), "h", *(F.col(f).alias(f"coef_{f}") for f in features))
        terms = sum((F.coalesce(F.col(f"coef_{f}") * F.col(f), F.lit(0.0)) for f in features), F.lit(0.0))
        out = laid.join(each, ["_s", "h"], "left").withColumn("correction", terms)
    return out.select(F.col("_s").alias(SERIES), DECIDED, "ts", "h", *PARTS, "model", "correction", (F.col("model") + F.col("correction")).alias("pred"))


def history_told(archive: DataFrame, measured: DataFrame, until: DataFrame, days: int) -> DataFrame:
    """series_id, ts, temp, wind, sun, gloom over the ``days`` before a decision: each slot as issued before it, less the bias of the days up to two
    before its own (the last that an issue of the day before knows). One decision a series."""
    values = ["temp", "cloud", "wind"]
    sun = measured.groupBy(SERIES, floor_to(F.col("ts"), 60).alias("_h")).agg(F.avg("sun").alias("sun")).withColumnRenamed("_h", "ts")
    kt = tables(cell_values(binned(in_time(archive, ["cloud"]).join(sun, [SERIES, "ts"])), until))
    told = slots(foreseen(archive, until, values, f"{days} days 1 hours", "0 hours"), kt, f"{days} days", "0 hours")
    both = materialised(told.join(measured.select(SERIES, "ts", F.col("temp").alias("_temp"), F.col("wind").alias("_wind")), [SERIES, "ts"]), "foreseen-history")
    for c in ("temp", "wind"):
        bias = bias_history(both, c, f"_{c}", BIAS_DAYS).select(SERIES, F.col("d").alias("_d"), F.col("h").alias("_h"), "bias")
        local = local_parts(both).withColumns({"_d": F.col("date_local"), "_h": F.floor("tod")})
        fixed = F.col(c) - F.coalesce("bias", F.lit(0.0))
        both = local.join(bias, [SERIES, "_d", "_h"], "left").withColumn(c, F.greatest(fixed, F.lit(0.0)) if c == "wind" else fixed).select(*both.columns)
    return both.select(SERIES, "ts", "temp", "wind", "sun", "gloom")


def correction_coefficients(rows: DataFrame, archive: DataFrame, until: DataFrame, params: DataFrame, layout: Layout, days: int = 90, horizons: list[int] | None = None) -> DataFrame:
    """series_id, h and a coefficient for each feature, from all issues of the ``days`` before a decision whose targets are known at it, with
    predictions remade at each issue under the weather foreseen then. ``until``: one decision a series."""
    cut = until.select(SERIES, F.col(DECIDED).alias("_cut"))
    known = rows.join(cut, SERIES).filter((F.col("ts") < F.col("_cut")) & (F.col("ts") >= F.col("_cut") - F.expr(f"interval {days + (BEFORE + 1) * DAYS} days"))).drop("_cut")
    told = history_told(archive, known, until, days)
    chunks = chunked(known, "coefficient-chunks", forecast=told)
    step = 60 * C.STEP_MINUTES
    start = F.floor(F.unix_timestamp(F.col("_cut") - F.expr(f"interval {days} days")) / step) * step
    own = params.join(cut, SERIES).select(SERIES, F.lit("").alias("fold"), "span", "theta", "coef", start.alias("valid_from"), F.unix_timestamp("_cut").alias("valid_to"))
    cube = I.remade_cube(chunks, own, layout, C.STEP_MINUTES / 60, horizons or list(range(AHEAD)))  # earlier rows are only what filters remember
    return I.horizon_coefficients(cube, [*I.FEATURES, *I.WEATHER_FEATURES])
