"""Fits, backtests, scenarios and streams as queries. Model queries run on a series with known truth for each region of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators import calendar as K
from loadloom.operators.timeaxis import SERIES, floor_to, resample
from loadloom.plans import backtest, cleaned, intraday, longterm, operation, scenario, synthetic
from loadloom.plans import fit as M
from loadloom.plans import kept as moments
from loadloom.plans.chunks import chunked
from loadloom.plans.design import Layout
from loadloom.queries.base import query, table, tidy
from loadloom.sources.store import exists, export_history, shared_folder, written
from loadloom.streaming import arrivals as A
from loadloom.streaming import series as X

#: Two years of quarter hours for each region; the backtest rolls over the second one.
FIRST, DAYS = "2022-01-01", 730
LAST, BEYOND = "2023-12-31", "2025-01-15"
LAYOUT = Layout(FIRST, DAYS)
MEASURES, CALENDAR = ["load", "temp", "sun", "wind", "dark", "gloom"], ["date_local", "daytype", "holiday", "after_off", "bridge", "bridge_len", "periods", "summer_day", "irregular", "context"]
_kept: dict[tuple, tuple] = {}


def kept(spark, sf, name, make):
    """A table that several queries read: written once for a session and folder, and again if it is gone."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept or not exists(spark, _kept[key][0]):
        df = make()
        _kept[key] = (written(df, name), df.schema)
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)


def quarters(spark, sf):
    """Quarter-hourly load, weather and calendar of each region's series."""
    names = table(spark, sf, "region").select(F.col("r_name").alias(SERIES)).distinct()
    return kept(spark, sf, "series-quarters", lambda: synthetic.load_series(spark, FIRST, BEYOND, DAYS, names))


def hours(spark, sf):
    """Their hourly means."""
    return kept(spark, sf, "series-hours", lambda: resample(quarters(spark, sf), 60, MEASURES, CALENDAR).withColumn("tod", F.hour(F.convert_timezone(F.lit("UTC"), F.lit(C.ZONE), F.col("ts").cast("timestamp_ntz"))).cast("double")))


def hour_chunks(spark, sf):
    return kept(spark, sf, "chunks-hours", lambda: chunked(hours(spark, sf)))


def quarter_chunks(spark, sf):
    return kept(spark, sf, "chunks-quarters", lambda: chunked(quarters(spark, sf)))


def hourly_fit(spark, sf):
    """Shapes and coefficients of the hourly series, by the staged chain from the default start."""
    return kept(spark, sf, "fit-hours", lambda: M.from_scratch(None, LAYOUT, 1.0, chunks=hour_chunks(spark, sf)))


def fitted(spark, sf):
    """Shapes from hours, coefficients from quarter hours."""
    return kept(spark, sf, "fit-quarters", lambda: M.linear(None, LAYOUT, 0.25, hourly_fit(spark, sf), quarter_chunks(spark, sf)))


def shape_rows(params, *others):
    return params.select(SERIES, *others, "n", F.col("rmse"), F.posexplode("theta").alias("i", "value")).withColumn("name", F.element_at(F.array(*map(F.lit, M.NAMES)), F.col("i") + 1)).drop("i")


@query()
def joint_fit_params(spark, sf):
    """The shapes of all series from the default start: staged chain and joint fit on hours, coefficients and errors on quarter hours."""
    return shape_rows(fitted(spark, sf))


@query()
def joint_fit_direct(spark, sf):
    """All components at once from the default start, without the stages before."""
    return shape_rows(M.joint(None, LAYOUT, 1.0, chunks=hour_chunks(spark, sf)))


@query()
def staged_fit_report(spark, sf):
    """RMSE of each stage of the chain: base on mild days, heating on cold ones, cooling with generation on all, everything."""
    chunks = hour_chunks(spark, sf)
    now, out = M.start(chunks.select(SERIES).distinct(), LAYOUT), None
    for number, stage in enumerate(M.staged(LAYOUT, passes=4)):
        now = M.run_stages(chunks, now, LAYOUT, 1.0, [stage])
        row = now.select(SERIES, F.lit(number).alias("stage"), F.lit(stage.rows).alias("rows"), "n", "rmse")
        row = kept(spark, sf, f"stage-{number}", lambda row=row: row)
        out = row if out is None else out.unionByName(row)
    return out


@query()
def fit_components(spark, sf):
    """Eleven additive parts of the load of every quarter hour."""
    return M.explained(M.predict(quarter_chunks(spark, sf), fitted(spark, sf), LAYOUT, 0.25))


@query()
def weather_effects(spark, sf):
    return M.weather_effects(quarter_chunks(spark, sf), fitted(spark, sf), LAYOUT, 0.25)


def issues(spark, sf):
    """The issue days of a year: every target is a whole day of the series' last 365 but for the first."""
    days = F.sequence(F.to_date(F.lit("2023-01-01")), F.to_date(F.lit("2023-12-30")), F.expr("interval 1 day"))
    return backtest.shape_days(table(spark, sf, "region").select(F.col("r_name").alias(SERIES)).distinct().select(SERIES, F.explode(days).alias("issue")))


def weekly(spark, sf):
    """Shapes of each week of the year, refitted on what was known."""

    def make():
        chunks, days = hour_chunks(spark, sf), issues(spark, sf)
        first = days.groupBy(SERIES).agg(F.min("day").alias("day"))
        begun = backtest.weekly_shapes(chunks, first, LAYOUT, 1.0, passes=8)
        return backtest.weekly_shapes(chunks, days, LAYOUT, 1.0, params=begun, passes=3)

    return kept(spark, sf, "backtest-shapes", make)


def daily_coefficients(spark, sf):
    """Coefficients of each day of the year on what was known."""
    return kept(spark, sf, "backtest-coefficients", lambda: backtest.refitted(hour_chunks(spark, sf), issues(spark, sf), weekly(spark, sf), LAYOUT, 1.0))


def backtested(spark, sf):
    """Daily issues over a year: shapes refitted every week on what was known, coefficients every day."""
    return kept(spark, sf, "backtest", lambda: backtest.day_ahead(hour_chunks(spark, sf), issues(spark, sf), daily_coefficients(spark, sf), LAYOUT, 1.0))


@query()
def d1_backtest(spark, sf):
    """Scores of each month, of the model alone and with the online correction."""
    found = backtest.corrected(backtested(spark, sf), K.date_dimension(spark, FIRST, BEYOND))
    plain = backtest.report(found)
    better = backtest.report(found, "corrected")
    return plain.join(better.select(SERIES, "month", F.col("rmse").alias("rmse_corrected"), F.col("mape").alias("mape_corrected")), [SERIES, "month"])


@query()
def d1_forecasts(spark, sf):
    """Every forecast of the backtest, with its correction."""
    found = backtest.corrected(backtested(spark, sf), K.date_dimension(spark, FIRST, BEYOND))
    return found.select(SERIES, "issue", "ts", "load", "base", "heating", "cooling", "pv", "model", "correction", "corrected")


@query()
def leave_out_folds(spark, sf):
    """Each year left out, and the second year from the first alone."""
    cases = [("2022", "2022-01-01", "2022-12-31", False), ("2023", "2023-01-01", "2023-12-30", False), ("forward", "2023-01-01", "2023-12-30", True)]
    fold = F.array(*(F.struct(F.lit(n).alias("fold"), F.to_date(F.lit(a)).alias("first"), F.to_date(F.lit(b)).alias("last"), F.lit(f).alias("forward")) for n, a, b, f in cases))
    folds = table(spark, sf, "region").select(F.col("r_name").alias(SERIES)).distinct().select(SERIES, F.inline(fold))
    return backtest.left_out(hour_chunks(spark, sf), LAYOUT, 1.0, folds)


@query()
def intraday_horizons(spark, sf):
    """Every hourly issue of two years at all horizons up to 39 hours."""
    told = M.predict(hour_chunks(spark, sf), hourly_fit(spark, sf), LAYOUT, 1.0)
    return intraday.by_horizon(intraday.backtest(told, list(range(39)), 24))


def noisy_forecast(rows):
    """Forecast weather: a bias of the hour and noise."""
    noisy = lambda salt: synthetic.noise(F.col(SERIES), F.unix_timestamp("ts"), salt)
    return rows.select(SERIES, "ts", (F.col("temp") + 1 + 0.5 * noisy(21)).alias("temp"), (F.col("sun") * (1 + 0.2 * noisy(22))).alias("sun"), F.greatest(F.col("wind") + noisy(23), F.lit(0.0)).alias("wind"), "gloom")


@query()
def intraday_forecast_weather(spark, sf):
    """The same with forecast weather (a bias of the hour and noise), as it stood at each issue: predictions are remade for it."""
    rows = hours(spark, sf).filter("ts >= '2023-07-01'")
    chunks = chunked(rows, "intraday-chunks", forecast=noisy_forecast(rows))
    return intraday.by_horizon(intraday.backtest_remade(chunks, hourly_fit(spark, sf), LAYOUT, 1.0, list(range(39))))


@query()
def intraday_daily_coefficients(spark, sf):
    """E25: every hourly issue of a year under forecast weather, with the shapes of its week and the coefficients of its day; the residuals that
    correct it are those of these coefficients too."""
    rows = hours(spark, sf).filter("ts >= '2022-07-01'")
    chunks = chunked(rows, "intraday-year", forecast=noisy_forecast(rows))
    return intraday.by_horizon(intraday.backtest_remade(chunks, intraday.daily(daily_coefficients(spark, sf)), LAYOUT, 1.0, list(range(39))))


@query()
def scenario_year(spark, sf):
    """A year ahead under past years' weather, by the hour, with its band."""
    return longterm.summary(scenario_rows(spark, sf))


def scenario_rows(spark, sf):
    return kept(spark, sf, "scenario-rows", lambda: year_ahead(spark, sf, "scenarios"))


def year_ahead(spark, sf, weather, trend="last"):
    span = F.sequence(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-12-30 23:00:00").cast("timestamp"), F.expr("interval 1 hour"))
    axis = table(spark, sf, "region").select(F.col("r_name").alias(SERIES)).distinct().select(SERIES, F.explode(span).alias("ts"))
    ahead = K.with_calendar(axis, K.date_dimension(spark, "2023-12-01", "2025-01-15"))
    return longterm.forecast(hours(spark, sf), ahead, hourly_fit(spark, sf), LAYOUT, 1.0, weather=weather, trend=trend, years=2)


@query()
def scenario_months(spark, sf):
    """Monthly means over scenarios and their quantiles, and those of normal weather with a held and with a half-damped heating trend."""
    wide = scenario.monthly(scenario_rows(spark, sf), "pred").withColumn("rule", F.lit("scenarios"))
    for rule in ("hold", "heating:0.5"):
        wide = wide.unionByName(scenario.monthly(year_ahead(spark, sf, "normal", rule), "pred").withColumn("rule", F.lit(f"normal, {rule}")))
    return wide


@query()
def weather_cleaned_load(spark, sf):
    """Load without weather, and with that of normal weather, by month."""
    chunks, params = hour_chunks(spark, sf), hourly_fit(spark, sf)
    normal = chunked(scenario.normal_weather(hours(spark, sf), ["temp", "sun", "wind"]), "normal-chunks")
    both = M.cleaned(M.predict(chunks, params, LAYOUT, 1.0), M.predict(normal, params, LAYOUT, 1.0))
    return both.groupBy(SERIES, F.date_format("ts", "yyyy-MM").alias("month")).agg(*(F.avg(c).alias(c) for c in ("load", "cleaned", "normalised")))


def cleaned_rows(spark, sf):
    return kept(spark, sf, "cleaned-history", lambda: cleaned.history(M.predict(hour_chunks(spark, sf), hourly_fit(spark, sf), LAYOUT, 1.0)))


@query()
def cleaned_history_export(spark, sf):
    """K8, Q14: the history without heating and cooling as csv files of each series and year, read back, with the model's shares by month, year
    and in all."""
    path = f"{shared_folder(spark)}/cleaned-{uuid.uuid4().hex}"
    export_history(cleaned_rows(spark, sf), path)
    text = spark.read.option("sep", ";").option("header", True).csv(path)
    number = lambda c: F.regexp_replace(c, ",", ".").cast("double").alias(c)
    return cleaned.shares(text.select(SERIES, F.to_date("date_local").alias("date_local"), *map(number, cleaned.VALUES)), 24)


@query()
def production_forecast(spark, sf):
    """From the end of the data to 39 hours ahead under the weather that came: the refit decision, the model's parts and the correction by horizon.
    (With weather as it was foreseen: ``foreseen_forecast``.)"""
    rows = quarters(spark, sf)
    end = F.lit("2023-11-20 09:00:00").cast("timestamp")
    horizon = F.col("ts") < end + F.expr("interval 39 hours")
    frame = rows.filter(horizon).withColumn("load", F.when(F.col("ts") < end, F.col("load")))
    layout = Layout(FIRST, 688)
    known = chunked(frame, "production-chunks")
    hourly = chunked(resample(frame.filter(F.col("ts") < end), 60, MEASURES, CALENDAR).withColumn("tod", F.hour(F.convert_timezone(F.lit("UTC"), F.lit(C.ZONE), F.col("ts").cast("timestamp_ntz"))).cast("double")), "production-hours")
    params = kept(spark, sf, "production-fit", lambda: operation.update(known, hourly, None, layout, 0.25, operation.refit(None, None, 0)))
    told = M.predict(known, params, layout, 0.25).filter(F.col("ts") < end)
    coefs = intraday.coefficients(intraday.cube(told.filter(F.col("ts") >= end - F.expr("interval 90 days")), list(range(0, 156))))
    return operation.forecast(known, params, layout, 0.25, coefs)


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")  # a pattern, since the source of a stream has to be a folder or a pattern
    return events.select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("""SELECT event_type AS series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value), 4) AS value, count(value)::BIGINT AS n FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def stream_tumbling_windows(spark, sf):
    found = X.tumbling(event_stream(spark, sf), "value", late="60 days")
    return tidy(X.latest(spark, X.run_available(found, "update"), found.schema, [SERIES, "ts"]))


@query("""WITH o AS (SELECT unnest(generate_series(0, 3)) AS k)
SELECT event_type AS series_id, strftime(time_bucket(INTERVAL 6 HOUR, ts) - to_hours((6 * k)::BIGINT), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value), 4) AS value, count(value)::BIGINT AS n FROM events, o GROUP BY ALL""")
def stream_sliding_windows(spark, sf):
    """Means of 24 hours, every 6 hours."""
    found = X.tumbling(event_stream(spark, sf), "value", "24 hours", late="60 days", slide="6 hours")
    return tidy(X.latest(spark, X.run_available(found, "update"), found.schema, [SERIES, "ts"]))


@query("""WITH s AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM s)
SELECT event_type AS series_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, strftime(max(ts) + INTERVAL 20 MINUTE, '%Y-%m-%d %H:%M:%S') AS until, round(avg(value), 4) AS value, count(value)::BIGINT AS n FROM g GROUP BY event_type, g
HAVING max(ts) + INTERVAL 20 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    """Runs of events without a pause of 20 minutes, of those that the watermark has closed."""
    found = X.sessions(event_stream(spark, sf), "value", "20 minutes", "1 hour")
    end = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("e")).first()["e"]
    rows = spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(X.run_available(found))
    return tidy(rows.filter(F.col("until") < F.lit(end) - F.expr("interval 1 hour")))


@query("""WITH RECURSIVE m AS (SELECT event_type AS series_id, ts, avg(value) AS value FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM m),
e AS (SELECT series_id, k, ts, value, value AS y FROM n WHERE k = 1 UNION ALL SELECT n.series_id, n.k, n.ts, n.value, e.y + (1 - exp(-(epoch_us(n.ts) - epoch_us(e.ts)) / 3.6e9::DOUBLE / 6)) * (n.value - e.y) FROM e JOIN n ON n.series_id = e.series_id AND n.k = e.k + 1)
SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(value, 4) AS value, round(y, 4) AS ema FROM e""")
def stream_exponential_filter(spark, sf):
    found = X.filtered(event_stream(spark, sf), "value", 6.0)
    path = X.run_available(found)
    rows = spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(path)
    return tidy(rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))  # whole instants, since several lie in one second


@query("""WITH q AS (SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM q),
i AS (SELECT series_id, max(ts) + INTERVAL 15 MINUTE AS issued, avg(CASE WHEN k <= 4 THEN v END) AS pred FROM r GROUP BY 1), h AS (SELECT unnest(generate_series(0, 3)) AS h)
SELECT series_id, strftime(issued, '%Y-%m-%d %H:%M:%S') AS issued_at, strftime(issued + to_minutes((15 * h)::BIGINT), '%Y-%m-%d %H:%M:%S') AS ts, round(pred, 4) AS pred FROM i, h""")
def stream_forecast_on_arrival(spark, sf):
    """A forecast of the next hour after each arrival: the mean of the last four quarter hours."""

    def ahead(batch):
        q = batch.groupBy(SERIES, floor_to(F.col("ts"), 15).alias("slot")).agg(F.avg("value").alias("v"))
        last = q.withColumn("k", F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("slot")))).groupBy(SERIES).agg((F.max("slot") + F.expr("interval 15 minutes")).alias("issued_at"), F.avg(F.when(F.col("k") <= 4, F.col("v"))).alias("pred"))
        steps = F.explode(F.sequence(F.col("issued_at"), F.col("issued_at") + F.expr("interval 45 minutes"), F.expr("interval 15 minutes")))
        return last.select(SERIES, "issued_at", steps.alias("ts"), "pred")

    return tidy(spark.read.parquet(X.on_arrival(event_stream(spark, sf), ahead)).withColumn("issued_at", F.col("issued_at").cast("timestamp")).select(SERIES, "issued_at", "ts", "pred"))


#: Hourly means of the events, the hour's mean of their series as a model, and its values of the next six hours.
HOURLY = """v AS (SELECT event_type AS series_id, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS k, avg(value) AS load FROM events GROUP BY ALL), m AS (SELECT series_id, k % 24 AS h, avg(load) AS model FROM v GROUP BY ALL)"""


@query(f"""WITH {HOURLY}, r AS (SELECT v.series_id, k, load, load - model AS e FROM v JOIN m ON m.series_id = v.series_id AND m.h = v.k % 24),
f AS (SELECT *, CASE WHEN count(e) OVER l >= 2 AND count(e) OVER d >= 12 THEN avg(e) OVER l END AS x1, CASE WHEN count(e) OVER l >= 2 AND count(e) OVER d >= 12 THEN avg(e) OVER d END AS xday FROM r
 WINDOW l AS (PARTITION BY series_id ORDER BY k RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), d AS (PARTITION BY series_id ORDER BY k RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)),
i AS (SELECT f.series_id, f.k, a.h, f.x1, f.xday, f.k + 1 + a.h AS t, m.model AS told FROM f, (SELECT unnest(generate_series(0, 5)) AS h) a JOIN m ON m.series_id = f.series_id AND m.h = (f.k + 1 + a.h) % 24),
p AS (SELECT i.series_id, i.h, i.t AS k, x1 * x1 AS s0, x1 * xday AS s1, xday * xday AS s2, x1 * (v.load - told) AS s3, xday * (v.load - told) AS s4 FROM i JOIN v ON v.series_id = i.series_id AND v.k = i.t WHERE x1 IS NOT NULL),
s AS (SELECT i.*, coalesce(sum(s0), 0) AS s0, coalesce(sum(s1), 0) AS s1, coalesce(sum(s2), 0) AS s2, coalesce(sum(s3), 0) AS s3, coalesce(sum(s4), 0) AS s4, count(s0) AS n FROM i LEFT JOIN p ON p.series_id = i.series_id AND p.h = i.h AND p.k <= i.k GROUP BY ALL),
c AS (SELECT *, s0 + 0.001 * (s0 + s2) / 2 + 1e-12 AS a, s2 + 0.001 * (s0 + s2) / 2 + 1e-12 AS d FROM s), o AS (SELECT *, CASE WHEN x1 IS NOT NULL AND n >= 21 THEN (s3 * d - s1 * s4) / (a * d - s1 * s1) * x1 + (a * s4 - s1 * s3) / (a * d - s1 * s1) * xday ELSE 0 END AS correction FROM c)
SELECT series_id, strftime(make_timestamp((k + 1) * 3600000000), '%Y-%m-%d %H:%M:%S') AS issued_at, strftime(make_timestamp(t * 3600000000), '%Y-%m-%d %H:%M:%S') AS ts, h::BIGINT AS h, round(told, 4) AS model, round(correction, 4) AS correction, round(told + correction, 4) AS pred FROM o""")
def stream_model_forecast(spark, sf):
    """X6: six hours ahead from every hour of the events as it arrives, by a model of the hour and a correction learned from forecasts that came
    true, in a stream of several triggers."""
    load = resample(event_stream_rows(spark, sf), 60, ["value"]).select(SERIES, (F.unix_timestamp("ts") / 3600).cast("long").alias("k"), F.col("value").alias("load"))
    hourly = load.groupBy(SERIES, F.pmod("k", F.lit(24)).alias("_h")).agg(F.avg("load").alias("model"))
    ring = F.map_from_entries(F.collect_list(F.struct("_h", "model")))
    profile = hourly.groupBy(SERIES).agg(ring.alias("_p"))  # 24 values a series
    files = X.in_order(load, "k", "arrivals", 4)
    came = spark.readStream.schema("series_id string, k long, load double").option("maxFilesPerTrigger", 1).parquet(files)
    of = lambda k: F.element_at("_p", F.pmod(k, F.lit(24)))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.coalesce(of(F.col("k") + i), F.lit(float("nan"))))
    rows = came.join(profile, SERIES).select(SERIES, "k", "load", of(F.col("k")).alias("model"), ahead.alias("ahead"))
    found = A.forecasts(rows, 3600, 6, 24, patience=1)  # hours come in order, so a missing one is given up at once
    return tidy(spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(X.run_available(found)))


def event_stream_rows(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("""SELECT event_type AS series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value), 4) AS value, count(value)::BIGINT AS n FROM events GROUP BY 1, date_trunc('hour', ts)""")
def stream_late_rows(spark, sf):
    """X1 with T15: events that come out of order, in four files with two hours of patience. What the watermark drops comes back by the side path:
    the windows are those of all rows."""
    rows = event_stream_rows(spark, sf)
    mixed = X.in_order(rows, F.pmod(F.xxhash64("ts", "value"), F.lit(4)), "late", 4)
    came = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(mixed)
    closed, kept_rows = A.with_late_path(came, "value", "1 hour", "2 hours")
    read = lambda path, schema: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    found = A.settled(read(closed, f"{SERIES} string, ts timestamp, value double, n long"), read(kept_rows, rows.schema), "value", 3600)
    return tidy(found.select(SERIES, "ts", "value", "n"))


@query()
def daily_refits(spark, sf):
    """E16, E40: refits of four days from kept moments. On the third, a week of the past of every other series has been revised, which its
    stored state and the count of revised rows turn into a decision; only the chunks concerned are read again."""
    days = [f"2023-12-{d} 09:00:00" for d in (18, 19, 20, 21)]
    stamp = lambda x: F.lit(x).cast("timestamp")
    own = hourly_fit(spark, sf).select(SERIES, F.lit("2023-12-18").alias("fold"), "span", "theta")
    hit = (F.pmod(F.xxhash64(SERIES), F.lit(2)) == 0) & F.col("ts").between(stamp("2023-11-06 00:00:00"), stamp("2023-11-12 23:00:00"))
    revised = hours(spark, sf).filter(hit).select(SERIES, "ts")
    changed = kept(spark, sf, "chunks-revised", lambda: chunked(hours(spark, sf).withColumn("load", F.when(hit, F.col("load") + 30).otherwise(F.col("load"))), "chunks-revised"))
    stored, out = None, None
    for k, day in enumerate(days):
        now = own.withColumns({"until": F.unix_timestamp(stamp(day)), "since": F.unix_timestamp(stamp(days[max(k - 1, 0)]))})
        chunks, news = (changed, revised) if k == 2 else (changed if k > 2 else hour_chunks(spark, sf), revised.limit(0))
        states = own.select(SERIES, stamp(days[max(k - 1, 0)]).alias("fitted_at"), F.when(F.lit(k > 0), stamp(days[0])).alias("shapes_at"))
        what = moments.decided(states, news, stamp(day))
        if stored is None:
            stored = moments.blocks(chunks, now, LAYOUT, 1.0)
        else:
            stored = moments.refreshed(stored, chunks, now, LAYOUT, 1.0, news if k == 2 else None)
        stored = kept(spark, sf, f"moments-{k}", lambda stored=stored: stored)
        row = moments.coefficients(stored, now, LAYOUT).select(SERIES, F.lit(day).alias("day"), "n", "rmse").join(what.select(SERIES, "revised_rows", "what"), SERIES)
        out = row if out is None else out.unionByName(row)
    return out
