"""Forecasts on arrival equal those of a table, however the input is cut; the late path gives back what the watermark drops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.operators.timeaxis import SERIES
from loadloom.streaming import arrivals as A
from loadloom.streaming import series as X

STEP, HORIZONS, A_DAY = 3600, 4, 24


@pytest.fixture(scope="module")
def made(spark):
    rng, rows = np.random.default_rng(5), []
    for s in ("a", "b", "c"):
        model, e = 100 + 10 * np.sin(np.arange(260) / 4), 0.0
        for k in range(240):
            e = 0.8 * e + rng.normal()
            if s == "b" and k % 17 == 3 or s == "c" and 100 < k < 140:
                continue  # never comes
            load = float("nan") if s == "b" and k % 29 == 5 else float(model[k] + e + 2)
            ahead = [float("nan") if (k + h) % 31 == 0 else float(x) for h, x in enumerate(model[k + 1 : k + 1 + HORIZONS])]
            rows.append((s, 1000 + k, load, float(model[k]), ahead))
    return spark.createDataFrame(rows, f"{SERIES} string, k long, load double, model double, ahead array<double>").cache()


def streamed(spark, df, folder, parts, patience):
    for n in range(max(p for p in parts.values()) + 1):
        keys = [k for k, p in parts.items() if p == n]
        if keys:
            df.filter(F.col("k").isin(keys)).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = A.forecasts(rows, STEP, HORIZONS, A_DAY, patience)
    got = spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(X.run_available(found)).collect()
    assert len({tuple(r[:4]) for r in got}) == len(got)
    return {tuple(r[:4]): tuple(r[4:]) for r in got}


@pytest.mark.parametrize("cut", ["one", "five", "shuffled"])
def test_stream_equals_table(spark, made, tmp_path, cut):
    want = {tuple(r[:4]): tuple(r[4:]) for r in A.forecasts_batch(made, STEP, HORIZONS, A_DAY).collect()}
    assert len(want) > 2000 and sum(abs(v[1]) > 1e-6 for v in want.values()) > 1500
    rng = random.Random(2)
    parts = {1000 + k: {"one": 0, "five": k // 48}.get(cut, max(0, (k + rng.randrange(-5, 6)) // 40)) for k in range(240)}
    got = streamed(spark, made, str(tmp_path / "in"), parts, 12)
    ends = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=STEP * (1240 - 12))  # slots behind a missing one may still wait at the end
    missed = want.keys() - got.keys()
    assert got.keys() <= want.keys() and all(k[1] > ends for k in missed)
    assert max(abs(got[k][j] - want[k][j]) for k in got for j in range(3)) < 1e-9


def test_table_against_a_plain_loop(made):
    rows = {r["k"]: r for r in made.filter(f"{SERIES} = 'b'").collect()}
    want, errors, waiting, g, n = {}, {}, {}, {h: np.zeros(5) for h in range(HORIZONS)}, dict.fromkeys(range(HORIZONS), 0)
    for k in sorted(rows):
        r = rows[k]
        if not np.isnan(r["load"]):
            errors[k] = r["load"] - r["model"]
            for h, x1, xd, told in waiting.pop(k, []):
                e = r["load"] - told
                g[h] += (x1 * x1, x1 * xd, xd * xd, x1 * e, xd * e)
                n[h] += 1
        last, day = ([errors[j] for j in range(k - m + 1, k + 1) if j in errors] for m in (4, A_DAY))
        usable = len(last) >= 2 and len(day) >= A_DAY // 2
        for h, told in enumerate(r["ahead"]):
            if np.isnan(told):
                continue
            correction = 0.0
            if usable:
                x1, xd = np.mean(last), np.mean(day)
                if n[h] >= 21:
                    a, b, d, p, q = g[h]
                    correction = np.linalg.solve(np.array([[a, b], [b, d]]) + (1e-3 * (a + d) / 2 + 1e-12) * np.eye(2), [p, q]) @ (x1, xd)
                waiting.setdefault(k + 1 + h, []).append((h, x1, xd, told))
            want[k, h] = correction
    got = {(int(r["issued_at"].timestamp()) // STEP - 1, r["h"]): r["correction"] for r in A.forecasts_batch(made, STEP, HORIZONS, A_DAY).filter(f"{SERIES} = 'b'").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_late_rows_come_back(spark, tmp_path):
    rng, begin = random.Random(4), dt.datetime(2024, 3, 1)
    rows = [(s, begin + dt.timedelta(minutes=11 * i), float(rng.randrange(100))) for s in ("a", "b") for i in range(400)]
    early, late = [r for r in rows if rng.random() < 0.8], []
    late = [r for r in rows if r not in early] + [("a", begin - dt.timedelta(hours=30), 5.0)]  # an hour of late rows only
    schema = f"{SERIES} string, ts timestamp, value double"
    for part in (early[: len(early) // 2], early[len(early) // 2 :], late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    came = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed, kept = A.with_late_path(came, "value", "1 hour", "2 hours")
    read = lambda path, kind: spark.read.schema(kind).option("recursiveFileLookup", True).parquet(path)
    told = read(closed, f"{SERIES} string, ts timestamp, value double, n long")
    found = {(r[SERIES], r["ts"]): r for r in A.settled(told, read(kept, schema), "value", 3600).collect()}
    whole = {}
    for s, ts, v in early + late:
        whole.setdefault((s, ts.replace(minute=0)), []).append(v)
    assert found.keys() == whole.keys() and all(found[k]["n"] == len(v) and abs(found[k]["value"] - np.mean(v)) < 1e-9 for k, v in whole.items())
    states = {k: r["state"] for k, r in found.items()}
    assert set(states.values()) == {"closed", "revised", "late", "open"} and states["a", begin - dt.timedelta(hours=30)] == "late"
    assert all(r["before"] == r["value"] for r in found.values() if r["state"] == "closed")
    n_closed = {(r[SERIES], r["ts"]): r["n"] for r in told.collect()}
    assert any(n_closed[k] < found[k]["n"] for k in n_closed) and all(states[k] == ("closed" if n_closed[k] == found[k]["n"] else "revised") for k in n_closed)
