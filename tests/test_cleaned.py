"""The cleaned history against sums by hand, and its files against the rows they hold."""

import datetime as dt

import pytest

from loadloom import registry
from loadloom.plans import cleaned
from loadloom.queries import models as Q
from loadloom.sources.store import export_history

SCHEMA = "series_id string, ts timestamp, date_local date, load double, heating double, cooling double"


def made(spark, rows):
    return cleaned.history(spark.createDataFrame([(s, t, (t + dt.timedelta(hours=1)).date(), y, h, c) for s, t, y, h, c in rows], SCHEMA))


@pytest.fixture(scope="module")
def rows():
    first = dt.datetime(2022, 12, 29, 23)  # midnight in local time
    hours = [("a", first + dt.timedelta(hours=k), 100.0 + k % 7, 10.0 + k % 3, float(k % 2)) for k in range(24 * 5)]
    hours[3] = (*hours[3][:2], None, 1.0, 1.0)
    hours[4] = (*hours[4][:2], float("nan"), 1.0, 1.0)
    hours[30] = (*hours[30][:2], 50.0, float("nan"), 1.0)
    return [*hours, ("b", first, 0.0, 0.0, 0.0), ("c", first, None, 0.0, 0.0)]


def test_shares_by_hand(spark, rows):
    got = {(r["series_id"], r["period"]): r for r in cleaned.shares(made(spark, rows), 24).collect()}
    assert set(got) == {("a", "2022-12"), ("a", "2023-01"), ("a", "2022"), ("a", "2023"), ("a", "all"), ("b", "2022-12"), ("b", "2022"), ("b", "all")}
    assert got["b", "all"]["share_heating"] is None and got["b", "all"]["days"] == 1 / 24
    local = lambda r: r[1] + dt.timedelta(hours=1)
    for period, pattern in (("2022-12", "%Y-%m"), ("2023", "%Y"), ("all", "all")):
        known = [r for i, r in enumerate(rows) if r[0] == "a" and i not in (3, 4, 30) and local(r).strftime(pattern) == period]
        n, load, heat, cool = len(known), *(sum(r[i] for r in known) for i in (2, 3, 4))
        r = got["a", period]
        want = {"actual": load / n, "heating": heat / n, "cooling": cool / n, "cleaned": (load - heat - cool) / n, "days": n / 24, "share_heating": 100 * heat / load, "share_cooling": 100 * cool / load}
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items()), period
    days = [r["date_local"].day for r in cleaned.daily(made(spark, rows), 24).filter("series_id = 'a'").orderBy("date_local").collect()]
    assert days == [31, 1, 2, 3]  # the first day lacks two hours, the second one
    assert cleaned.shares(made(spark, rows).limit(0)).count() == 0


def test_files_of_a_year(spark, rows, tmp_path):
    path = f"file://{tmp_path}/history"
    frame = made(spark, rows)
    export_history(frame, path)
    export_history(frame.filter("date_local >= '2023-01-01'"), path)  # other years stay
    files = sorted(p for p in tmp_path.glob("history/series_id=a/year=*/*.csv"))
    assert [p.parent.name for p in files] == ["year=2022", "year=2023"]
    lines = [line.split(";") for p in files for line in p.read_text().splitlines()[1:]]
    assert [x[0] for x in lines] == [r[1].strftime("%Y-%m-%d %H:%M:%S") for r in rows[:120]]
    assert lines[0][1] == "2022-12-30 00:00" and lines[0][3] == "100,000" and lines[0][4] == "90,000" and lines[3][3] in ("", '""')


def test_registered_export(spark, medium):
    got = {(r["series_id"], r["period"]): r for r in registry.queries()["cleaned_history_export"](spark, medium).collect()}
    want = {(r["series_id"], r["period"]): r for r in cleaned.shares(Q.cleaned_rows(spark, medium), 24).collect()}
    assert got.keys() == want.keys() and len({s for s, _ in got}) == 5
    for k, r in want.items():
        assert all(abs(got[k][c] - r[c]) < 2e-3 for c in (*cleaned.VALUES, "days")), k
    for s in {s for s, _ in got}:
        assert got[s, "2022-01"]["share_heating"] > got[s, "2022-07"]["share_heating"] and got[s, "2022-07"]["share_cooling"] > got[s, "2022-01"]["share_cooling"]
