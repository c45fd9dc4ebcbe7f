"""Settings, cached loads and file formats beyond what the registered queries show."""

import os
import time

import pytest
import yaml
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.sources import files as S
from loadloom.sources import settings, store


def test_settings_override_bounds_starts_and_priors(tmp_path):
    path = tmp_path / "model.yaml"
    path.write_text("heating:\n  tau: {bounds: [10, 100], start: 40, prior: [70, 10]}\n  b: {fixed: 0}\npv:\n  gamma: {fixed: 0.005}\n")
    found = {s.name: s for part in settings.shapes(str(path)).values() for s in part}
    assert (found["tau"].low, found["tau"].high, found["tau"].start, found["tau"].prior) == (10, 100, 40, (70, 10))
    assert found["b"].fixed == 0 and found["gamma"].fixed == 0.005
    assert found["t_b"] == next(s for s in C.HEATING_SHAPES if s.name == "t_b")
    for wrong in ("heating:\n  nothing: {start: 1}\n", "other: {}\n", "heating:\n  tau: {bounds: [1, 2], start: 3}\n", "- a list\n"):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            settings.shapes(str(path))
    path.write_text("")
    assert settings.shapes(str(path)) == settings.SECTIONS


def test_shown_parameters(tmp_path):
    theta = {"tau": 79.933612345, "t_b": 17.0, "tau_c": 0.00012345678, "gamma": 0.004}
    path = str(tmp_path / "shown.yaml")
    settings.write_shown(theta, path, {"mean heating": 123.4567891})
    assert settings.read_shown(path) == {"tau": 79.9336, "t_b": 17.0, "tau_c": 0.000123457, "gamma": 0.004}
    assert yaml.safe_load(open(path))["derived"] == {"mean heating": 123.457}


def test_workspace_falls_back(tmp_path):
    (tmp_path / "own" / "config").mkdir(parents=True)
    (tmp_path / "own" / "config" / "a.yaml").write_text("")
    assert S.workspace(str(tmp_path / "own"), "a.yaml", "/common") == str(tmp_path / "own" / "config" / "a.yaml")
    assert S.workspace(str(tmp_path / "own"), "b.yaml", "/common") == "/common/b.yaml"


def test_loads_are_kept_by_the_files_manifest(spark, tmp_path):
    folder, cache, read = tmp_path / "in", str(tmp_path / "cache"), []
    folder.mkdir()
    (folder / "a.csv").write_text("x;y\n1;2\n")

    def load():
        read.append(1)
        return S.raw_csv(spark, f"{folder}/*.csv", ["x", "y"]).select("x", "y")

    one = lambda: sorted(map(tuple, S.stable_load(spark, str(folder), load, cache, wait=0.1).collect()))
    assert one() == [("1", "2")] and one() == [("1", "2")] and len(read) == 1
    (folder / "b.csv").write_text("x;y\n3;4\n")
    assert one() == [("1", "2"), ("3", "4")] and len(read) == 2

    def restless():
        (folder / "c.csv").write_text(f"x;y\n{time.time()};{'9' * len(os.listdir(folder))}\n" * (len(read) + 1))
        return load()

    (folder / "d.csv").write_text("x;y\n")
    with pytest.raises(RuntimeError):
        S.stable_load(spark, str(folder), restless, cache, tries=2, wait=0.1)


def test_lines_before_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title\n\nDen;Hodina;v\n01.01.2024;1;1,5\n01.01.2024;2;x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿Den;Hodina;v\n02.01.2024;1;2,5\n", encoding="utf-8")
    rows = S.raw_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], ["d", "h", "v"], header_cell="Den")
    got = sorted((r["d"], r["h"], r["n"]) for r in rows.select("d", "h", S.number("v").alias("n")).collect())
    assert got == [("01.01.2024", "1", 1.5), ("01.01.2024", "2", None), ("02.01.2024", "1", 2.5)]


def test_stamps_that_do_not_exist_fail_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp;v\n31.03.2024 1:45;1\n31.03.2024 2:15;2\n")
    with pytest.raises(Exception, match="no such local time"):
        S.series_csv(spark, f"{tmp_path}/a.csv", ["v"], "s").collect()


def test_the_repeated_hour_with_gaps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp;v\n27.10.2024 1:45;0\n27.10.2024 2:00;1\n27.10.2024 2:45;2\n27.10.2024 2:15;3\n27.10.2024 2:30;4\n27.10.2024 3:00;5\n")
    got = [(r["ts"].strftime("%H:%M"), r["v"]) for r in S.series_csv(spark, f"{tmp_path}/a.csv", ["v"], "s").orderBy("ts").collect()]
    assert [v for _, v in got] == [0, 1, 2, 3, 4, 5] and len({t for t, _ in got}) == 6


def test_backtest_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0)], "series_id string, issue string, pred double")
    for _ in range(2):
        store.save_backtest(rows, rows.select("series_id"), rows.select("pred"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/forecasts").count() == 2 and spark.read.parquet(f"{tmp_path}/coefficients").agg(F.sum("pred")).first()[0] == 3


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Elsewhere())
