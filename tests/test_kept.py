"""Refits from kept moments against fits on all rows; decisions against the rules for one state."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.operators.timeaxis import SERIES
from loadloom.plans import fit as M
from loadloom.plans import kept as K
from loadloom.plans import operation, synthetic
from loadloom.plans.chunks import chunked
from loadloom.plans.design import NAMES, Layout
from loadloom.sources.store import materialised

FIRST, DAYS = "2022-01-01", 330
LAYOUT = Layout(FIRST, DAYS)


@pytest.fixture(scope="module")
def rows(spark):
    return materialised(synthetic.load_series(spark, FIRST, "2022-12-31", DAYS, 2, minutes=60), "kept-rows")


def version(spark, until, since=None):
    theta = F.array(*(F.lit(float(synthetic.TRUTH[n])) for n in NAMES))
    of = lambda x: F.unix_timestamp(F.lit(x).cast("timestamp"))
    found = spark.createDataFrame([("s0",), ("s1",)], f"{SERIES} string").select(SERIES, F.lit("week 1").alias("fold"), F.lit(DAYS).alias("span"), theta.alias("theta"), of(until).alias("until"))
    return found if since is None else found.withColumn("since", of(since))


def full_fit(spark, chunks, until):
    now = version(spark, until)
    begun = M.start(now.select(SERIES, F.col("theta").alias("_t"), F.col("until").alias("_u")), LAYOUT, columns={"fold": F.lit("week 1"), "until": F.col("_u"), "theta": F.col("_t")})
    return {r[SERIES]: r for r in M.linear(None, LAYOUT, 1.0, begun, chunks).collect()}


def assert_equal(spark, blocks, chunks, until):
    want = full_fit(spark, chunks, until)
    got = {r[SERIES]: r for r in K.coefficients(blocks, version(spark, until), LAYOUT).collect()}
    assert got.keys() == want.keys() == {"s0", "s1"}
    for s in want:
        assert got[s]["n"] == want[s]["n"] and abs(got[s]["rmse"] - want[s]["rmse"]) < 1e-8
        assert np.allclose(got[s]["coef"], want[s]["coef"], rtol=1e-8, atol=1e-8 * np.abs(want[s]["coef"]).max())


def test_daily_refits_and_revisions_equal_full_fits(spark, rows):
    days = ["2022-10-20 09:00:00", "2022-10-21 09:00:00", "2022-11-12 09:00:00"]  # the last lies in a later chunk
    chunks = chunked(rows, "kept-chunks")
    stored = materialised(K.blocks(chunks, version(spark, days[0]), LAYOUT, 1.0), "kept-blocks")
    assert_equal(spark, stored, chunks, days[0])
    for before, now in zip(days[:-1], days[1:], strict=True):
        stored = materialised(K.refreshed(stored, chunks, version(spark, now, before), LAYOUT, 1.0), "kept-blocks")
        assert_equal(spark, stored, chunks, now)
    # weather and load of some past rows of one series change
    hit = (F.col(SERIES) == "s1") & F.col("ts").between(F.lit("2022-04-03").cast("timestamp"), F.lit("2022-04-05").cast("timestamp"))
    changed = rows.withColumns({"load": F.when(hit, F.col("load") + 40).otherwise(F.col("load")), "temp": F.when(hit, F.col("temp") - 5).otherwise(F.col("temp"))})
    chunks2 = chunked(changed, "kept-chunks-2")
    later = "2022-11-13 09:00:00"
    revised = rows.filter(hit).select(SERIES, "ts")
    again = materialised(K.refreshed(stored, chunks2, version(spark, later, days[-1]), LAYOUT, 1.0, revised), "kept-blocks")
    assert_equal(spark, again, chunks2, later)
    # without the revisions the old moments would still stand
    plain = K.coefficients(K.refreshed(stored, chunks2, version(spark, later, days[-1]), LAYOUT, 1.0), version(spark, later), LAYOUT).filter(f"{SERIES} = 's1'").first()
    assert abs(plain["rmse"] - full_fit(spark, chunks2, later)["s1"]["rmse"]) > 1e-3


def test_a_refresh_reads_only_the_grown_chunk(spark, rows):
    chunks = chunked(rows, "kept-chunks")
    part = K.seen(chunks.filter(F.col("chunk") >= chunks.agg(F.max("chunk")).first()[0]), version(spark, "2022-11-13 09:00:00", "2022-11-12 09:00:00"), LAYOUT, 1.0, True)
    found = part.groupBy(SERIES).agg(F.sum("n").alias("n"), F.count_distinct("chunk").alias("c")).collect()
    assert len(found) == 2 and all(r["n"] == 24 and r["c"] == 1 for r in found)


def test_decisions_follow_the_rules_for_one_state(spark):
    now, cases = datetime(2024, 5, 10, 9), []
    for k, (fitted, shapes, revised) in enumerate((f, s, r) for f in (0.5, 1.0, 3.2) for s in (0.5, 6.9, 7.0, None) for r in (0, 95, 96)):
        shapes_at = None if shapes is None else now - timedelta(days=shapes)
        cases.append((f"c{k}", now - timedelta(days=fitted), shapes_at, revised))
    states = spark.createDataFrame([c[:3] for c in cases], f"{SERIES} string, fitted_at timestamp, shapes_at timestamp")
    revisions = spark.createDataFrame([(c[0],) for c in cases for _ in range(c[3])], f"{SERIES} string")
    got = {r[SERIES]: r for r in K.decided(states, revisions, F.lit(now)).collect()}
    for name, fitted_at, shapes_at, revised in cases:
        state = None if shapes_at is None else operation.State(fitted_at, shapes_at, 100)
        assert got[name]["what"] == operation.refit(state, now, revised) and got[name]["revised_rows"] == revised


def test_registered_refits(spark, medium):
    from loadloom import registry

    rows = registry.queries()["daily_refits"](spark, medium).collect()
    assert len(rows) == 20 and {r["what"] for r in rows} == {"shapes", "linear"}
    for s in {r[SERIES] for r in rows}:
        own = sorted((r for r in rows if r[SERIES] == s), key=lambda r: r["day"])
        assert [b["n"] - a["n"] for a, b in zip(own[:-1], own[1:], strict=True)] == [24, 24, 24]
        assert own[2]["revised_rows"] in (0, 168) and (own[2]["rmse"] > own[1]["rmse"] + 1) == (own[2]["revised_rows"] == 168)
