"""Forecast weather at an instant of decision: nothing later enters; the issues that count; the chain against its parts."""

import datetime as dt
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom import registry
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import backtest as B
from loadloom.plans import fit as M
from loadloom.plans import foreseen as E
from loadloom.plans import synthetic
from loadloom.plans.chunks import chunked
from loadloom.plans.correction import debias
from loadloom.plans.design import NAMES, Layout
from loadloom.queries.foreseen import made_archive
from loadloom.sources.store import materialised

FIRST, DAYS = "2022-03-01", 230
CUT, LATER = "2022-09-20 09:00:00", "2022-10-01 17:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture(scope="module")
def made(spark):
    rows = materialised(synthetic.load_series(spark, FIRST, "2022-12-31", DAYS), "foreseen-rows")
    archive = materialised(made_archive(rows), "foreseen-archive")
    layout = Layout(FIRST, 203)
    theta = F.array(*(F.lit(float(synthetic.TRUTH[n])) for n in NAMES))
    start = M.start(rows.select(SERIES).distinct(), layout, columns={"until": F.unix_timestamp(at(CUT))}).withColumn("theta", theta)
    params = materialised(M.linear(None, layout, 0.25, start, chunked(rows)), "foreseen-params")
    decisions = rows.select(SERIES).distinct().select(SERIES, F.explode(F.array(at(CUT), at(LATER))).alias(E.DECIDED))
    return rows, archive, layout, params, decisions


def of_cut(df):
    return sorted(tuple(r) for r in df.filter(F.col(E.DECIDED) == at(CUT)).collect())


def test_nothing_after_the_decision_enters(made):
    rows, archive, layout, params, decisions = made
    coefs = E.correction_coefficients(rows, archive, decisions.filter(F.col(E.DECIDED) == at(CUT)), params, layout, days=12, horizons=[0, 1, 2, 4, 8, 20])
    plain = materialised(E.forecast(rows, archive, decisions, params, layout, coefs), "foreseen-plain")
    want = of_cut(plain)
    assert len(want) == 148  # to the end of the local day after, issued at 10 (8 UTC)
    changed = lambda c, v: F.when(F.col("ts") >= at(CUT), F.col(c) + v).otherwise(F.col(c)).alias(c)
    rows2 = rows.select(*(changed(c, 100.0) if c in ("load", "temp", "sun", "wind") else F.col(c) for c in rows.columns))
    late = archive.filter(F.col("ts") >= at("2022-08-01 00:00:00")).select(SERIES, "ts", F.greatest(at(CUT) + F.expr("interval 1 second"), F.col("ts") - F.expr("interval 1 hour")).alias(E.ISSUED), (F.col("temp") + 50).alias("temp"), F.lit(0.0).alias("cloud"), F.lit(99.0).alias("wind"))
    hindsight = archive.select(SERIES, "ts", (F.col("ts") + F.expr("interval 10 minutes")).alias(E.ISSUED), (F.col("temp") - 70).alias("temp"), F.lit(1.0).alias("cloud"), F.lit(9.0).alias("wind"))
    archive2 = archive.unionByName(late.filter(F.col(E.ISSUED) > at(CUT))).unionByName(hindsight)
    coefs2 = E.correction_coefficients(rows2, archive2, decisions.filter(F.col(E.DECIDED) == at(CUT)), params, layout, days=12, horizons=[0, 1, 2, 4, 8, 20])
    got = of_cut(E.forecast(rows2, archive2, decisions, params, layout, coefs2))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)
    assert any(abs(r[-2]) > 1e-3 for r in want if r[3] in (0, 1, 2, 4, 8, 20)) and all(r[-2] == 0 for r in want if r[3] not in (0, 1, 2, 4, 8, 20))


def test_latest_issue_in_time(spark):
    day = dt.datetime(2022, 5, 2)
    h = lambda n: day + dt.timedelta(hours=n)
    archive = [("a", h(0), h(-14), 1.0), ("a", h(0), h(-6), 2.0), ("a", h(0), h(1), 3.0), ("a", h(5), h(-14), 4.0), ("a", h(5), h(2), 5.0), ("a", h(9), h(4), 6.0), ("a", h(30), h(-1), 7.0), ("a", h(30), h(-1), 8.0), ("a", h(400), h(-1), 9.0), ("b", h(5), h(-1), 10.0)]
    rows = spark.createDataFrame(archive, f"{SERIES} string, ts timestamp, issued_at timestamp, temp double")
    decisions = spark.createDataFrame([("a", h(0)), ("a", h(3)), ("c", h(0))], f"{SERIES} string, decided_at timestamp")
    found = E.foreseen(rows, decisions, ["temp"], "1 days", "39 hours").select("decided_at", "ts", "temp").collect()
    assert sorted(tuple(r) for r in found) == [(h(0), h(0), 2.0), (h(0), h(5), 4.0), (h(0), h(30), 8.0), (h(3), h(0), 2.0), (h(3), h(5), 5.0), (h(3), h(30), 8.0)]


def test_bias_and_sunshine_are_removed(made):
    rows, archive, _, _, decisions = made
    told = E.weather_at(archive, rows, decisions).filter(F.col("ts") >= F.col(E.DECIDED)).alias("t")
    both = told.join(rows.alias("m"), [SERIES, "ts"])
    assert told.count() == 148 + 116  # the later decision is at 19 local time
    n, hot, windy, bright, grey = both.agg(F.count("*"), F.avg(F.col("t.temp") - F.col("m.temp")), F.avg(F.col("t.wind") - F.col("m.wind")), F.avg(F.col("t.sun") - F.col("m.sun")), F.avg(F.abs(F.col("t.gloom") - F.col("m.gloom")))).first()
    assert n > 150 and abs(hot) < 0.35 and abs(windy) < 0.25 and abs(bright) < 25 and grey < 0.12


def test_without_correction_it_is_the_model_under_spliced_weather(made):
    rows, archive, layout, params, decisions = made
    one = decisions.filter(F.col(E.DECIDED) == at(LATER))
    got = {r["ts"]: r for r in E.forecast(rows, archive, one, params, layout).collect()}
    told = E.weather_at(archive, rows, one).select(SERIES, "ts", *(F.col(c).alias(f"_{c}") for c in ("temp", "sun", "wind", "gloom")))
    both = rows.filter(F.col("ts") < at(LATER) + F.expr("interval 39 hours")).join(told, [SERIES, "ts"], "left").filter((F.col("ts") < at(LATER)) | F.col("_temp").isNotNull())
    spliced = both.select(*(F.when(F.col("ts") >= at(LATER), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("temp", "sun", "wind", "gloom") else F.col(c) for c in rows.columns))
    want = M.predict(chunked(spliced, "by-hand"), params, layout, 0.25).filter((F.col("ts") >= at(LATER)) & ~F.isnan("model")).collect()
    assert len(want) == len(got) > 100
    assert all(abs(got[r["ts"]]["model"] - r["model"]) < 1e-6 and got[r["ts"]]["pred"] == got[r["ts"]]["model"] for r in want)


def test_registered_forecast(spark, medium):
    rows = registry.queries()["foreseen_horizons"](spark, medium).collect()
    rmse = lambda name: np.sqrt(np.average([r["rmse"] ** 2 for r in rows if r["forecast"] == name], weights=[r["n"] for r in rows if r["forecast"] == name]))
    assert len({r["hours_ahead"] for r in rows}) > 24 and rmse("corrected") < 0.8 * rmse("model") and rmse("corrected") < 6


def test_cells_by_hand(spark):
    """Shares that are negative, huge, tied, infinite in number or missing; thin cells, heights without full ones, decisions that know nothing."""
    rng, day = np.random.default_rng(3), dt.datetime(2022, 1, 1)
    odd = (0.5, 0.5, 0.5, -3.25, 9e7, -9e7, 4096.0, 0.0)
    rows = []
    for k in range(6000):
        s, c, h = ("a", "b")[k % 3 == 0], int(rng.integers(0, 4)), int(rng.integers(0, 3))
        share = 1.0 if c == 1 else odd[int(rng.integers(0, 8))] if c == 2 else float(rng.normal(0.5, 0.2)) + h
        if (c, h) in ((0, 2), (3, 2), (1, 2), (2, 2)) and k % 97 or (c, h) == (3, 0) and k % 11:
            continue
        clear = float(2 ** int(rng.integers(0, 9)))
        rows.append((s, day + dt.timedelta(hours=k), c, h, None if k % 50 == 7 else share * clear, clear))
    decided = [("a", rows[0][1]), ("a", day + dt.timedelta(hours=900)), ("a", day + dt.timedelta(hours=4001)), ("a", day + dt.timedelta(hours=9000)), ("b", day + dt.timedelta(hours=3000)), ("c", day + dt.timedelta(hours=3000))]
    frame = spark.createDataFrame(rows, f"{SERIES} string, ts timestamp, cloud_bin int, sun_bin int, sun double, clear double").repartition(5)
    least, quantiles = 12, (0.0, 0.1, 0.37, 0.9, 1.0)
    got = {tuple(r)[:5]: r["v"] for r in E.cell_values(frame, spark.createDataFrame(decided, f"{SERIES} string, decided_at timestamp"), 5, 4, least, quantiles).collect()}
    assert len(got) == len(decided) * 5 * 4 * 6

    def values(found):
        shares = [r[4] / r[5] for r in found if r[4] is not None]
        return [sum(r[4] for r in found if r[4] is not None) / sum(r[5] for r in found), *np.quantile(shares, quantiles)] if shares else [None] * 6

    for s, at_ in decided:
        known = [r for r in rows if r[0] == s and r[1] < at_]
        alone = [values([r for r in known if r[2] == c]) for c in range(5)]
        for h in range(4):
            own = {c: values(found) for c in range(5) if len(found := [r for r in known if r[2:4] == (c, h)]) >= least}
            for c in range(5):
                for i in range(6):
                    want = np.interp(c, list(own), [v[i] for v in own.values()]) if own else alone[c][i]
                    have = got[s, at_, c, h, i]
                    assert have is want is None or abs(have - want) <= 1e-9 * max(1, abs(want)), (s, at_, c, h, i, have, want)


def test_no_task_holds_a_cells_shares(spark):
    """What is sent between tasks is counts and the shares of some bins: less than one number for each row, at any number of decisions."""
    n, day = 200_000, "timestamp'2022-01-01'"
    rows = spark.range(n, numPartitions=4).select(F.lit("a").alias(SERIES), (F.expr(day) + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.lit(0).alias("cloud_bin"), F.lit(0).alias("sun_bin"), F.rand(7).alias("sun"), F.lit(1.0).alias("clear"))
    decided = spark.range(3).select(F.lit("a").alias(SERIES), (F.expr(day) + F.make_dt_interval(secs=(F.col("id") + 1) * n / 3)).alias(E.DECIDED))

    def sent():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = sent()
    found = E.cell_values(rows, decided, 1, 1, 12, (0.1, 0.9)).collect()
    assert len(found) == 9 and all(abs(r["v"] - (0.5, 0.1, 0.9)[r["i"]]) < 0.01 for r in found)
    assert sent() - before < 8 * n


ISSUED_ON = ("2022-09-24", "2022-09-28", "2022-09-29")  # a chunk ends two hours into the target of the second


def issued(rows):
    return rows.select(SERIES).distinct().select(SERIES, F.explode(F.array(*(F.to_date(F.lit(x)) for x in ISSUED_ON))).alias("issue"), F.to_date(F.lit(ISSUED_ON[0])).alias("day"))


def backtested(rows, archive, layout, params):
    begun = rows.select(SERIES).distinct().select(SERIES, F.timestamp_seconds(B.cutoff(F.to_date(F.lit(ISSUED_ON[0])))).alias(E.DECIDED))
    told = materialised(E.day_ahead_weather(archive, rows, begun), "told")
    issues = issued(rows)
    fitted = params.join(issues, SERIES).select(SERIES, F.col("day").cast("string").alias("fold"), "span", B.cutoff(F.col("issue")).alias("until"), "theta", "coef")
    return told, B.day_ahead(chunked(rows, "told-chunks", forecast=told), issues, fitted, layout, 0.25, B.horizon_bias(told, rows, issues))


def test_day_ahead_under_forecast_weather_is_the_model_under_weather_spliced_by_hand(made):
    rows, archive, layout, params, _ = made
    told, found = backtested(rows, archive, layout, params)
    got = {(r["issue"], r["ts"]): r["model"] for r in found.collect()}
    assert len(got) == 3 * 96
    for text in ISSUED_ON:
        day = dt.date.fromisoformat(text)
        cut = F.timestamp_seconds(B.cutoff(F.lit(day)))
        both = told.join(rows.select(SERIES, "ts", F.col("temp").alias("_t"), F.col("wind").alias("_w")), [SERIES, "ts"])
        less = debias(debias(both, "temp", "_t", cut), "wind", "_w", cut, floor=0.0).select(SERIES, "ts", *(F.col(c).alias(f"_{c}") for c in ("temp", "sun", "wind", "gloom")))
        spliced = rows.join(less, [SERIES, "ts"], "left").select(*(F.when(F.col("ts") >= cut, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in ("temp", "sun", "wind", "gloom") else F.col(c) for c in rows.columns))
        want = M.predict(chunked(spliced, "by-hand"), params, layout, 0.25).filter(F.col("date_local") == F.lit(day + dt.timedelta(days=1))).collect()
        assert len(want) == 96 and all(abs(got[day, r["ts"]] - r["model"]) < 1e-6 for r in want)
    plain = M.predict(chunked(rows, "plain"), params, layout, 0.25).filter(F.col("date_local") == F.lit(dt.date(2022, 9, 29))).collect()
    assert any(abs(got[dt.date(2022, 9, 28), r["ts"]] - r["model"]) > 0.5 for r in plain)


def test_nothing_after_the_cutoff_enters_a_day_ahead_forecast(made):
    rows, archive, layout, params, _ = made
    want = {(r["issue"], r["ts"]): r["model"] for r in backtested(rows, archive, layout, params)[1].collect() if str(r["issue"]) != ISSUED_ON[2]}
    cut = F.timestamp_seconds(B.cutoff(F.to_date(F.lit(ISSUED_ON[1]))))
    late = rows.select(*(F.when(F.col("ts") >= cut, F.col(c) + 60).otherwise(F.col(c)).alias(c) if c in ("load", "temp", "sun", "wind", "gloom") else F.col(c) for c in rows.columns))
    told_late = archive.select(SERIES, "ts", (F.greatest(cut, F.col("ts") - F.expr("interval 1 day")) + F.expr("interval 90 minutes")).alias(E.ISSUED), (F.col("temp") - 40).alias("temp"), F.lit(0.0).alias("cloud"), F.lit(50.0).alias("wind"))
    got = {(r["issue"], r["ts"]): r["model"] for r in backtested(late, archive.unionByName(told_late), layout, params)[1].collect() if str(r["issue"]) != ISSUED_ON[2]}
    assert got.keys() == want.keys() and len(want) == 2 * 96
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bias_of_a_horizon_by_hand(spark):
    """Over the change of clocks, with gaps, an hour without errors and an issue without history."""
    start = dt.datetime(2022, 9, 10)
    rng = np.random.default_rng(1)
    rows = [("a", start + dt.timedelta(minutes=30 * k), float(rng.normal()), float(rng.normal()) if k % 7 else None) for k in range(48 * 55)]
    rows = [r for r in rows if r[1].hour != 3]
    told = spark.createDataFrame(rows, f"{SERIES} string, ts timestamp, temp double, wind double")
    zero = told.withColumns({"temp": F.lit(0.0), "wind": F.lit(0.0)})
    days = [dt.date(2022, 9, 10), dt.date(2022, 9, 20), dt.date(2022, 10, 29), dt.date(2022, 10, 30)]
    found = B.horizon_bias(told, zero, spark.createDataFrame([("a", d) for d in days], f"{SERIES} string, issue date")).collect()
    assert len(found) == 4
    local = lambda t: t.replace(tzinfo=dt.UTC).astimezone(zoneinfo.ZoneInfo(C.ZONE))
    for r in found:
        cut = dt.datetime.combine(r["issue"], dt.time(9), zoneinfo.ZoneInfo(C.ZONE)).astimezone(dt.UTC).replace(tzinfo=None)
        for at_, kind in ((2, "temp"), (3, "wind")):
            for i, value in enumerate(r[f"bias_{kind}"]):
                hour = local(cut + dt.timedelta(hours=i)).hour
                errors = [x[at_] for x in rows if cut - dt.timedelta(days=30) <= x[1] < cut and local(x[1]).hour == hour and x[at_] is not None]
                assert abs(value - (np.mean(errors) if errors else 0.0)) < 1e-9
