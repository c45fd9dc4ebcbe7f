"""A year ahead: cutoffs, weather and trends as keys against one forecast after another; bands and their scores by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import fit as M
from loadloom.plans import longterm, scenario, synthetic
from loadloom.plans.chunks import chunked
from loadloom.plans.design import NAMES, Layout
from loadloom.sources.store import materialised

FIRST, DAYS = "2022-01-01", 450
CUTOFFS = ("2023-01-12", "2023-02-09")
CASES = [("given", "last"), ("given", "hold"), ("normal", "level:0"), ("scenarios", "last"), ("scenarios", "heating:0.5,pv:0")]


@pytest.fixture(scope="module")
def made(spark):
    names = spark.createDataFrame([("a",), ("b",)], f"{SERIES} string")
    rows = materialised(synthetic.load_series(spark, FIRST, "2023-04-30", DAYS, names, minutes=60), "longterm-rows")
    layout = Layout(FIRST, DAYS)
    at = F.col("fold").cast("timestamp")
    theta = F.array(*(F.lit(float(synthetic.TRUTH[n])) for n in NAMES))
    start = M.start(names.select(SERIES, F.explode(F.array(*map(F.lit, CUTOFFS))).alias("fold")), layout, columns={"fold": F.col("fold"), "span": F.datediff("fold", F.lit(FIRST)), "until": F.unix_timestamp(at)}).withColumn("theta", theta)
    params = materialised(M.linear(None, layout, 1.0, start, chunked(rows)), "longterm-params").withColumn("cutoff", at)
    found = materialised(longterm.forward(rows, params, layout, 1.0, CASES, days=30), "longterm-found")
    return rows, layout, params, found


def test_keys_equal_one_forecast_after_another(made):
    rows, layout, params, found = made
    got = {(r[SERIES], str(r["cutoff"].date()), r["weather"], r["trend"], r["shift"], r["ts"]): r["pred"] for r in found.collect()}
    n = 0
    for text in CUTOFFS:
        cut = F.lit(text).cast("timestamp")
        ahead = rows.filter((F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("interval 30 days")))
        own, plain = params.filter(F.col("cutoff") == cut), ahead.drop("load", "temp", "sun", "wind", "dark", "gloom")
        for weather, trend in CASES[1:4]:
            want = longterm.forecast(rows.filter(F.col("ts") < cut), plain, own, layout, 1.0, weather=weather, trend=trend, given=ahead).collect()
            assert len(want) in ((2 * 720,) if weather != "scenarios" else (2 * 720 * k for k in (3, 4, 5)))
            for r in want:
                assert abs(got[r[SERIES], text, weather, trend, r["shift"], r["ts"]] - r["pred"]) < 1e-7
            n += len(want)
    assert n < len(got) and {k[3] for k in got} == {t for _, t in CASES} and {(k[2], k[3]) for k in got} == set(CASES)


def test_what_came_later_changes_no_forecast_but_under_the_weather_given(made):
    rows, layout, params, found = made
    cut = F.lit(CUTOFFS[0]).cast("timestamp")
    late = rows.select(*(F.when(F.col("ts") >= cut, F.col(c) * 3 + 40).otherwise(F.col(c)).alias(c) if c in ("load", "temp", "sun", "wind", "dark", "gloom") else F.col(c) for c in rows.columns))
    key = ["weather", "trend", "shift", SERIES, "ts"]
    of = lambda df: {tuple(r[c] for c in key): r["pred"] for r in df.filter(F.col("cutoff") == cut).collect()}
    want, got = of(found), of(longterm.forward(late, params.filter(F.col("cutoff") == cut), layout, 1.0, CASES, days=30))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want if k[0] != "given") and any(abs(got[k] - want[k]) > 5 for k in want if k[0] == "given")


def test_scores_by_hand(made):
    *_, found = made
    pdf = found.toPandas()
    errors = pdf[(pdf.weather == "given") & (pdf.trend == "last")].assign(e=lambda d: (d.load - d.pred) ** 2)
    rows = longterm.judged(found).collect()
    assert len(rows) == 2 * 2 * len(CASES)
    for r in rows:
        other = errors[(errors[SERIES] == r[SERIES]) & (errors.cutoff != pd.Timestamp(r["cutoff"]))].e
        assert abs(r["sd"] - np.sqrt(other.mean())) < 1e-9
        own = pdf[(pdf[SERIES] == r[SERIES]) & (pdf.cutoff == pd.Timestamp(r["cutoff"])) & (pdf.weather == r["weather"]) & (pdf.trend == r["trend"])]
        at = own.groupby("ts").agg(mean=("pred", "mean"), low=("pred", "min"), high=("pred", "max"), load=("load", "first"), n=("pred", "size")).reset_index()
        e, m = at.load - at["mean"], (C.Z80 * r["sd"]) ** 2
        inside = (at.load >= at["mean"] - np.sqrt((at["mean"] - at.low) ** 2 + m)) & (at.load <= at["mean"] + np.sqrt((at.high - at["mean"]) ** 2 + m))
        months = e.groupby(at.ts.dt.strftime("%Y-%m")).mean()
        loads = at.load.groupby(at.ts.dt.strftime("%Y-%m")).mean()
        want = (len(at), at.n.max(), np.sqrt((e**2).mean()), 100 * (e.abs() / at.load).mean(), e.mean(), np.sqrt((months**2).mean()), 100 * (months.abs() / loads).mean(), ((at.load >= at.low) & (at.load <= at.high)).mean(), inside.mean())
        got = [r[c] for c in ("n", "scenarios", "rmse", "mape", "bias", "monthly_bias", "volume_mape", "coverage_weather", "coverage")]
        assert np.allclose(got, want, atol=1e-7)


def test_one_cutoff_has_no_band(made):
    *_, found = made
    rows = longterm.judged(found.filter(F.col("cutoff") == F.lit(CUTOFFS[0]).cast("timestamp"))).collect()
    assert len(rows) == 2 * len(CASES) and all(r["sd"] is None and r["coverage"] is None and r["rmse"] > 0 for r in rows)
    assert longterm.judged(found.limit(0)).count() == 0


def test_bands_of_few_scenarios_are_their_extremes_widened(spark):
    values = [1.0, 4.0, 5.0, 10.0]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), v) for v in values], f"{SERIES} string, ts timestamp, v double")
    for least, low, high in ((5, 1.0, 10.0), (4, np.quantile(values, 0.1), np.quantile(values, 0.9))):
        r = scenario.band(df, "v", 2.0, least=least).first()
        assert (r["low_weather"], r["high_weather"]) == pytest.approx((low, high))
        assert r["low"] == pytest.approx(5 - np.hypot(5 - low, C.Z80 * 2)) and r["high"] == pytest.approx(5 + np.hypot(high - 5, C.Z80 * 2))
