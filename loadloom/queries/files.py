"""Readers and writers as queries: series of the tables are written in each input format, read back, and told by SQL from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators import timeaxis as A
from loadloom.queries.base import AXIS, DAILY, QUARTER, daily, filled, quarter, query, rounded, table, tidy
from loadloom.sources import files as S
from loadloom.sources import store
from loadloom.sources.store import shared_folder

#: Days that move January to both clock changes of the year.
AUTUMN, SPRING = 285, 75
LOCAL = "timezone('Europe/Prague', timezone('UTC', {}))"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def put(lines: DataFrame, path: str, name: str, order: list[str], before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> str:
    """One text file of the column ``line`` in order, between given lines; a fixture, so it may be one task."""
    spark = lines.sparkSession
    key = F.struct(*order)
    whole = lines.select(F.lit(1).alias("_p"), key.alias("_o"), "line")
    edge = lambda texts, p: spark.createDataFrame([(p, i, t) for i, t in enumerate(texts)], "_p int, _i int, line string")
    rows = whole.withColumn("_i", F.lit(0)).unionByName(edge(before, 0), allowMissingColumns=True).unionByName(edge(after, 2), allowMissingColumns=True)
    rows.repartition(1).sortWithinPartitions("_p", "_i", "_o").select("line").write.text(f"{path}/.{name}")
    jvm = spark._jvm.org.apache.hadoop.fs
    source = jvm.Path(f"{path}/.{name}")
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.Path(f"{path}/{name}"))
    fs.delete(source, True)
    return f"{path}/{name}"


def comma(c: Column | str, places: int = 4) -> Column:
    shown = F.regexp_replace(F.format_string(f"%.{places}f", F.col(c) if isinstance(c, str) else c), r"\.", ",")
    return F.coalesce(shown, F.lit(""))


def local(ts: str = "ts") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(C.ZONE), F.col(ts).cast("timestamp_ntz"))


def shown(stamp: Column) -> Column:
    """'dd.MM.yyyy' at midnight, else with the time."""
    midnight = (F.hour(stamp) == 0) & (F.minute(stamp) == 0)
    return F.when(midnight, F.date_format(stamp, "dd.MM.yyyy")).otherwise(F.date_format(stamp, "dd.MM.yyyy H:mm"))


def moved(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("ts", F.col("ts") + F.expr(f"interval {days} days")).withColumn("value", rounded(F.col("value"), 4))


@query(f"""WITH {AXIS}, s AS (SELECT unnest([{AUTUMN}, {SPRING}]) AS days)
SELECT series_id || '-' || days AS series_id, {STAMP.format("ts + to_days(days::INT)")} AS ts, round(round(value, 4), 3) AS load FROM bothways, s""")
def source_series_csv(spark, sf):
    """Local-time csv with decimal commas over both clock changes: the repeated hour is told by order."""
    path, out = folder(spark), None
    whole = store.materialised(filled(spark, sf), "filled")  # read for every file
    names = [r["series_id"] for r in whole.select("series_id").distinct().orderBy("series_id").collect()]
    for k, series in enumerate(names):
        for days in (AUTUMN, SPRING):
            rows = moved(whole.filter(F.col("series_id") == series), days)
            file = put(rows.select("ts", F.concat_ws(";", shown(local()), comma("value")).alias("line")), path, f"series-{k}-{days}.csv", ["ts"], ("﻿timestamp;baseline",))
            read = S.series_csv(spark, file, ["load"], f"{series}-{days}")
            out = read if out is None else out.unionByName(read)
    return tidy(out, 3)


METEO = f"""q AS (WITH {AXIS} SELECT 'm' AS series_id, ts + to_days({AUTUMN}) AS ts, round(value, 4) + CASE WHEN hour(ts) = 5 THEN 0.5 ELSE 0 END AS value FROM bothways
WHERE series_id = 'view' AND ((hour(ts) * 4 + minute(ts) // 15) % 17 > 5 OR day(ts) <> 20))"""


@query(f"""WITH {AXIS.replace(QUARTER, METEO)}, ld AS (WITH {AXIS} SELECT ts + to_days({AUTUMN}) AS ts, round(value, 4) AS load FROM bothways WHERE series_id = 'click')
SELECT 'm' AS series_id, {STAMP.format("lim.ts")} AS ts, round(load, 3) AS load, round(lim.value, 3) AS temp, round(2 * lim.value, 3) AS sun FROM lim JOIN ld ON ld.ts = lim.ts WHERE lim.value IS NOT NULL AND load IS NOT NULL""")
def source_load_and_weather(spark, sf):
    """Both files with template rows after their ends; repeated weather stamps are averaged, gaps of up to four slots filled."""
    path = folder(spark)
    load = moved(filled(spark, sf).filter("series_id = 'click'"), AUTUMN)
    rows = load.select("ts", F.concat_ws(";", shown(local()), comma("value")).alias("line"))
    first = put(rows, path, "baseload.csv", ["ts"], ("timestamp;baseline",), ("01.12.2024;-1,0", "01.12.2024 0:15;-1,0"))
    meteo = moved(filled(spark, sf).filter("series_id = 'view' and ((hour(ts) * 4 + minute(ts) div 15) % 17 > 5 or day(ts) <> 20)"), AUTUMN)
    # a repeated row comes where its hour comes, so that order still tells the hours of the autumn change; 5 o'clock isn't among them
    twice = meteo.withColumn("_k", F.explode(F.when(F.hour("ts") == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    lines = twice.select("ts", "_k", F.concat_ws(";", shown(local()), comma((F.col("value") + F.col("_k")) * 2), F.lit("1,5"), comma(F.col("value") + F.col("_k"))).alias("line"))
    second = put(lines, path, "Meteo15.csv", ["ts", "_k"], ("timestamp;sun;wind;temp",), ("01.12.2024;;;", "01.12.2024 0:15;;;"))
    found = S.joined(S.series_csv(spark, first, ["load"], "m"), S.series_csv(spark, second, ["sun", "wind", "temp"], "m"))
    return tidy(found.select("series_id", "ts", "load", "temp", "sun"), 3)


HOURS = "hh AS (SELECT date_trunc('hour', ts) + to_days({days}) AS ts, round(avg(round(value, 4)), 4) AS v FROM bothways WHERE series_id = '{series}' GROUP BY 1)"


def whole_days(spark, sf, series, days):
    """Hourly means of whole local days, with the place in the day."""
    from pyspark.sql import Window

    rows = moved(filled(spark, sf).filter(F.col("series_id") == series), days)
    hours = rows.groupBy(A.floor_to(F.col("ts"), 60).alias("h")).agg(rounded(F.avg("value"), 4).alias("v")).withColumnRenamed("h", "ts").withColumn("d", F.to_date(local()))
    first = hours.agg(F.min("d").alias("a")).first()["a"]
    hours = hours.filter(F.col("d") > F.lit(first))
    return hours.withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("ts")))


def sql_days(series: str, days: int) -> str:
    return f"{HOURS.format(days=days, series=series)}, hd AS (SELECT ts, v, {LOCAL.format('ts')}::DATE AS d FROM hh), h AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts) AS n FROM hd WHERE d > (SELECT min(d) FROM hd))"


@query(f"WITH {AXIS}, {sql_days('error', AUTUMN)} SELECT {STAMP.format('ts')} AS ts, round(v, 3) AS temp, round((n * 3) % 100, 3)::DOUBLE AS cloud FROM h WHERE n <> 7")
def source_forecast_archive(spark, sf):
    """Hourly archive by position from local midnight, 25 rows on the day of the change; rows without a temperature are left out."""
    h = whole_days(spark, sf, "error", AUTUMN)
    line = F.concat_ws(";", F.date_format("d", "dd.MM.yyyy"), F.when(F.col("n") != 7, comma("v")).otherwise(""), comma(F.pmod(F.col("n") * 3, F.lit(100)).cast("double"), 1), F.lit("2,5"))
    file = put(h.select("ts", line.alias("line")), folder(spark), "ArchivMeteo.csv", ["ts"], ("cas;teplota;oblacnost;vitr",))
    return tidy(S.forecast_archive(spark, file, "a").select("ts", "temp", "cloud"), 3)


@query(f"""WITH {AXIS}, q2 AS (SELECT ts + to_days({AUTUMN}) AS ts, round(value, 4) AS v FROM bothways WHERE series_id = 'purchase'), d AS (SELECT *, {LOCAL.format("ts")}::DATE AS d FROM q2),
w AS (SELECT * FROM d WHERE d > (SELECT min(d) FROM d) AND d < (SELECT max(d) FROM d)), m AS (SELECT min(d) + 12 AS cut FROM w),
a AS (SELECT date_trunc('hour', ts) AS ts, round(avg(v), 3) AS e, round(avg(v) + 1, 3) AS p FROM w, m WHERE d <= cut GROUP BY 1), b AS (SELECT date_trunc('hour', ts) AS ts, sum(v) AS e, avg(v) AS p FROM w, m WHERE d >= cut GROUP BY 1)
SELECT {STAMP.format("coalesce(b.ts, a.ts)")} AS ts, round(coalesce(b.e, a.e), 3) AS energy, round(coalesce(b.p, a.p), 3) AS price FROM a FULL JOIN b ON a.ts = b.ts""")
def source_market(spark, sf):
    """An hourly and a quarter-hourly file with lines before the header: energies are summed, prices averaged, the later file wins."""
    from pyspark.sql import Window

    path = folder(spark)
    rows = moved(filled(spark, sf).filter("series_id = 'purchase'"), AUTUMN).withColumn("d", F.to_date(local()))
    first, last = rows.agg(F.min("d"), F.max("d")).first()
    rows = rows.filter((F.col("d") > F.lit(first)) & (F.col("d") < F.lit(last))).withColumn("_cut", F.date_add(F.lit(first), 13))
    h = rows.filter("d <= _cut").groupBy("d", A.floor_to(F.col("ts"), 60).alias("h")).agg(F.avg("value").alias("v")).withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("h")))
    q = rows.filter("d >= _cut").withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("ts")))
    line = lambda e, p: F.concat_ws(";", F.date_format("d", "dd.MM.yyyy"), F.col("n").cast("string"), comma(e, 4), comma(p, 4), F.lit("x"))
    before = ("Protokol;;;", "", "Den;Hodina;Objem;Cena;Poznamka")
    put(h.select("d", "n", line(rounded(F.col("v"), 3), rounded(F.col("v") + 1, 3)).alias("line")), path, "ZD_2024_1.csv", ["d", "n"], before)
    put(q.select("d", "n", line(F.col("value"), F.col("value")).alias("line")), path, "ZD_2024_2.csv", ["d", "n"], ("Den;Perioda;Objem;Cena;Poznamka",))
    files = [f"{path}/ZD_2024_1.csv", f"{path}/ZD_2024_2.csv"]
    energy = S.market(spark, files, ["energy", "price"], True).select("ts", "energy")
    price = S.market(spark, files, ["energy", "price"], False).select("ts", "price")
    return tidy(energy.join(price, "ts"), 3)


@query(f"WITH {AXIS}, {sql_days('signup', SPRING)} SELECT {STAMP.format('ts')} AS ts, round(v, 3) AS load, round(v * 2, 3) AS with_pumping FROM h")
def source_grid_load(spark, sf):
    """Two lines and a byte-order mark before the header; the spring day has 23 rows."""
    h = whole_days(spark, sf, "signup", SPRING)
    line = F.concat_ws(";", F.date_format("d", "dd.MM.yyyy"), comma(F.col("v") * 2), comma("v"))
    file = put(h.select("ts", line.alias("line")), folder(spark), "CEPS.csv", ["ts"], ("﻿Zatizeni;;", "od do;;", "Datum;s cerpanim;bez"))
    plain, pumped = S.grid_load(spark, file), S.grid_load(spark, file, with_pumping=True)
    return tidy(plain.join(pumped.withColumnRenamed("load", "with_pumping"), "ts"), 3)


@query(f"WITH {AXIS}, {sql_days('view', AUTUMN)} SELECT {STAMP.format('ts')} AS ts, round(CASE WHEN n <> 4 THEN v END, 3) AS actual, round(CASE WHEN n % 6 <> 0 THEN v + 1 END, 3) AS ahead FROM h WHERE n <> 4 OR n % 6 <> 0")
def source_transparency(spark, sf):
    """Market time units; '-' and 'n/e' are no values, and a file with a bracket in its name is a copy."""
    h, path = whole_days(spark, sf, "view", AUTUMN), folder(spark)
    wall = F.make_timestamp_ntz(F.year("d"), F.month("d"), F.day("d"), F.least(F.col("n") - 1, F.lit(23)), F.lit(0), F.lit(0))
    mtu = F.concat(F.date_format(wall, "dd/MM/yyyy HH:mm"), F.lit(" - "), F.date_format(wall + F.expr("interval 1 hour"), "dd/MM/yyyy HH:mm"))
    point = lambda c: F.format_string("%.4f", c)
    line = F.concat_ws(";", mtu, F.lit("BZN"), F.when(F.col("n") == 4, "n/e").otherwise(point(F.col("v"))), F.when(F.col("n") % 6 == 0, "-").otherwise(point(F.col("v") + 1)))
    lines = h.select("ts", line.alias("line"))
    head = ("mtu;area;actual;ahead",)
    files = [put(lines, path, "GUI_TOTAL_LOAD_DAYAHEAD_2024.csv", ["ts"], head), put(lines.withColumn("line", F.regexp_replace("line", "BZN;", "BZN;9")), path, "GUI_TOTAL_LOAD_DAYAHEAD_2024(1).csv", ["ts"], head)]
    return tidy(S.transparency(spark, files), 3)


OLD = "q AS (SELECT 'w' AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-20' GROUP BY 2)"


@query(f"""WITH {AXIS.replace(QUARTER, OLD)}, own AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT {STAMP.format("ts")} AS ts, round(value, 4) AS temp FROM lim WHERE value IS NOT NULL AND ts < (SELECT min(ts) FROM own) UNION ALL SELECT {STAMP.format("ts")} AS ts, round(value, 4) AS temp FROM own""")
def source_weather_history(spark, sf):
    """An older file's weather before the series' own."""
    q = quarter(spark, sf).filter("series_id = 'view'").select(F.lit("w").alias("series_id"), "ts", F.col("value").alias("temp"))
    return tidy(S.with_history(q.filter("ts >= '2024-01-15'"), q.filter("ts < '2024-01-20'"), ["temp"]).select("ts", "temp"))


@query("""SELECT n_name AS series_id, round(n_nationkey * 1.5 + CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 100 END, 4) AS tau, n_regionkey::BIGINT AS n FROM nation""")
def parameter_store(spark, sf):
    """The latest of two stored fits of each series; a third of the series has one only, and the first was stored twice."""
    n = table(spark, sf, "nation")
    path = f"{folder(spark)}/params"
    rows = lambda day, more: n.select(F.col("n_name").alias("series_id"), F.lit(day).cast("date").alias("fitted_at"), (F.col("n_nationkey") * 1.5 + more).alias("tau"), F.col("n_regionkey").alias("n"))
    store.save_params(rows("2024-01-01", 7.0), path)
    store.save_params(rows("2024-01-01", 0.0), path)
    store.save_params(rows("2024-01-08", 100.0).join(n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("series_id")), "series_id"), path)
    return tidy(store.load_params(spark, path).select("series_id", "tau", "n"))


@query(f"""WITH {QUARTER}, r AS (SELECT series_id, ts, value, date_trunc('day', ts) AS issued FROM q)
SELECT series_id, strftime(issued, '%Y-%m-%d') AS issued_at, count(*)::BIGINT AS n, round(sum(round(value, 3)), 3) AS total FROM r GROUP BY ALL""")
def forecast_archive_and_export(spark, sf):
    """An archive of issues, some written twice, and its csv with decimal commas, read back."""
    path = folder(spark)
    rows = quarter(spark, sf).withColumn("issued_at", F.to_date("ts"))
    store.archive(rows, f"{path}/archive")
    store.archive(rows.filter("day(issued_at) <= 10"), f"{path}/archive")
    store.export_csv(spark.read.parquet(f"{path}/archive").select("series_id", "issued_at", rounded(F.col("value"), 3).alias("value")), f"{path}/csv", 3)
    back = S.raw_csv(spark, f"{path}/csv/*.csv", ["series_id", "issued_at", "value"])
    return tidy(back.groupBy("series_id", "issued_at").agg(F.count("*").alias("n"), F.sum(S.number("value")).alias("total")), 3)


@query(f"""WITH {DAILY}, s AS (SELECT unnest([-364, 0, 364]) AS shift), x AS (SELECT a.d + shift::INT AS d, shift, total FROM daily a, s)
SELECT d::VARCHAR AS d, round(max(CASE WHEN shift = -364 THEN total END), 2) AS scenario_m364, round(max(CASE WHEN shift = 0 THEN total END), 2) AS scenario_p0, round(max(CASE WHEN shift = 364 THEN total END), 2) AS scenario_p364 FROM x GROUP BY 1""")
def scenario_columns(spark, sf):
    """Scenarios as columns, written and read back."""
    d = daily(spark, sf).select("d", F.explode(F.array(*map(F.lit, (-364, 0, 364)))).alias("shift"), "total").select(F.date_add("d", F.col("shift")).alias("d"), "shift", F.col("total").alias("pred"))
    path = f"{folder(spark)}/scenarios"
    store.scenario_table(d, [-364, 0, 364], keys=("d",)).write.parquet(path)
    return tidy(spark.read.parquet(path), 2)


@query("""WITH g AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1), h AS (SELECT unnest(generate_series(0, 38)) AS h)
SELECT h::BIGINT AS h, count(*)::BIGINT AS n, round(avg(t.v - s.v), 4) AS error FROM g s, h JOIN g t ON t.ts = s.ts + to_hours(h::BIGINT) GROUP BY 1""")
def horizon_cube_store(spark, sf):
    """All issues and horizons up to 38 hours of a persistence forecast, stored by horizon and read back."""
    g = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.avg("value").alias("v"))
    laid = g.select("ts", F.col("v").alias("pred"), F.explode(F.sequence(F.lit(0), F.lit(38))).alias("h")).withColumn("target", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("h") * 3600))
    path = f"{folder(spark)}/cube"
    store.save_cube(laid.join(g.select(F.col("ts").alias("target"), F.col("v").alias("actual")), "target"), path)
    return tidy(spark.read.parquet(path).groupBy("h").agg(F.count("*").alias("n"), F.avg(F.col("actual") - F.col("pred")).alias("error")))
