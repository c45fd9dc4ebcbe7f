"""Time axes, resampling, gap filling, local time, revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadloom.operators import timeaxis as A
from loadloom.queries.base import AXIS, QUARTER, STAMP, filled, quarter, query, table, tidy


@query(f"WITH {QUARTER} SELECT series_id, {STAMP} AS ts, round(value, 4) AS value FROM q")
def resample_15m(spark, sf):
    return tidy(quarter(spark, sf))


@query(f"""WITH {QUARTER} SELECT series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value), 4) AS value,
round(arg_min(value, ts), 4) AS first_value, count(*)::BIGINT AS n FROM q GROUP BY series_id, date_trunc('hour', ts)""")
def resample_hourly(spark, sf):
    q = quarter(spark, sf).withColumns({"first_value": F.col("value")})
    counts = q.groupBy("series_id", A.floor_to(F.col("ts"), 60).alias("ts")).agg(F.count("*").alias("n"))
    return tidy(A.resample(q, 60, ["value"], ["first_value"]).join(counts, ["series_id", "ts"]))


@query(f"""WITH {QUARTER}, ends AS (SELECT series_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM q GROUP BY 1),
days AS (SELECT series_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM ends),
m AS (SELECT series_id, date_trunc('day', ts) AS ts, avg(value) AS value, count(*) AS n FROM q GROUP BY 1, 2)
SELECT days.series_id, strftime(days.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 4) AS value, coalesce(n, 0)::BIGINT AS n FROM days LEFT JOIN m ON m.series_id = days.series_id AND m.ts = days.ts""")
def resample_daily_with_empty_bins(spark, sf):
    q = quarter(spark, sf)
    days = q.groupBy("series_id", A.floor_to(F.col("ts"), 1440).alias("ts")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return tidy(A.on_axis(days, 1440).withColumn("n", F.coalesce("n", F.lit(0))))


@query(f"WITH {AXIS} SELECT series_id, {STAMP} AS ts, round(raw, 4) AS raw, round(value, 4) AS value FROM lim")
def axis_gapfill_lerp_limit4(spark, sf):
    return tidy(A.fill(A.on_axis(quarter(spark, sf)).withColumn("raw", F.col("value")), "value"))


@query(f"WITH {AXIS} SELECT series_id, {STAMP} AS ts, round(value, 4) AS value FROM bothways")
def gapfill_both(spark, sf):
    return tidy(filled(spark, sf))


@query("""WITH t AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events), l AS (SELECT ts, timezone('Europe/Prague', timezone('UTC', ts)) AS lt FROM t)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(lt, '%Y-%m-%d') AS date_local, round(hour(lt) + minute(lt) / 60.0, 4) AS tod, (isodow(lt) - 1)::BIGINT AS dow,
month(lt)::BIGINT AS month, year(lt)::BIGINT AS year, least(dayofyear(ts), 365)::BIGINT AS doy, (hour(ts) * 4 + minute(ts) // 15)::BIGINT AS slot FROM l""")
def local_calendar_parts(spark, sf):
    doy, slot = A.doy_slot(F.col("ts"))
    return tidy(A.local_parts(quarter(spark, sf).select("ts").distinct()).withColumns({"doy": doy, "slot": slot}))


@query(f"""WITH {QUARTER}, s AS (SELECT series_id, row_number() OVER w AS n, epoch(ts) - epoch(lag(ts) OVER w) AS step FROM q WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, round(median(step) / 3600, 4) AS step_hours FROM s WHERE n <= 200 GROUP BY 1""")
def step_hours(spark, sf):
    return tidy(A.step_hours(quarter(spark, sf)))


@query(f"""WITH {QUARTER}, h AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM q GROUP BY 1, 2),
seg AS (SELECT series_id, ts, value, lead(ts) OVER w AS nt, lead(value) OVER w AS nv FROM h WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
ends AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM h GROUP BY 1),
keyed AS (SELECT q.series_id, q.ts, epoch(q.ts) - 1350 AS pos, greatest(least(date_trunc('hour', q.ts - INTERVAL 1350 SECOND), b), a) AS hour FROM q JOIN ends USING (series_id))
SELECT k.series_id, strftime(k.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN nt IS NULL THEN s.value ELSE s.value + (nv - s.value) * greatest(least((pos - epoch(hour)) / (epoch(nt) - epoch(hour)), 1.0), 0.0) END, 4) AS value
FROM keyed k LEFT JOIN seg s ON s.series_id = k.series_id AND s.ts = k.hour""")
def hourly_to_quarter_hours(spark, sf):
    q = quarter(spark, sf)
    return tidy(A.hours_to_slots(A.resample(q, 60, ["value"]), q.select("series_id", "ts"), ["value"]))


@query(f"WITH {QUARTER}, h AS (SELECT series_id, date_trunc('hour', ts) AS hour, avg(value) AS hourly FROM q GROUP BY 1, 2) SELECT q.series_id, {STAMP} AS ts, round(hourly, 4) AS hourly FROM q JOIN h ON h.series_id = q.series_id AND h.hour = date_trunc('hour', q.ts)")
def hourly_value_in_its_quarters(spark, sf):
    q = quarter(spark, sf)
    h = A.resample(q, 60, ["value"]).select("series_id", F.col("ts").alias("hour"), F.col("value").alias("hourly"))
    return tidy(q.withColumn("hour", A.floor_to(F.col("ts"), 60)).join(h, ["series_id", "hour"]).select("series_id", "ts", "hourly"))


@query(f"WITH {QUARTER} SELECT series_id, strftime(max(ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS data_until FROM q GROUP BY 1")
def end_of_data(spark, sf):
    return tidy(A.end_of_data(quarter(spark, sf)))


REVISED = "CASE WHEN hour(ts) = 5 THEN value + 1.5 WHEN minute(ts) = 45 THEN value + 1e-9 ELSE value END"


@query(f"WITH {QUARTER} SELECT series_id, {STAMP} AS ts, round({REVISED} - value, 4) AS d_value FROM q WHERE abs({REVISED} - value) > 1e-6")
def revisions_diff(spark, sf):
    q = quarter(spark, sf)
    return tidy(A.revisions(q, q.withColumn("value", F.expr(REVISED)), ["value"]))


@query(f"""WITH {AXIS}, cut AS (SELECT series_id, ts, value FROM f WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
SELECT series_id, count(*)::BIGINT AS n_past, round(sum(value), 2) AS sum_past FROM (
 SELECT g.series_id, g.ts, coalesce(c.value, NULL) AS raw, c.value FROM (SELECT DISTINCT series_id, unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-19 23:45:00', INTERVAL 15 MINUTE)) AS ts FROM q) g LEFT JOIN cut c USING (series_id, ts)) GROUP BY 1""")
def history_frame_measured(spark, sf):
    """Measured part of the frame around a cutoff (10 days of history, 2 days ahead)."""
    q = quarter(spark, sf)
    rows = A.history_frame(q.withColumn("raw", F.lit(0.0)), F.lit("2024-01-20 00:00:00").cast("timestamp"), 10, 2, ["value"]).filter("value is not null")
    measured = rows.join(q.select("series_id", "ts", F.col("value").alias("raw")), ["series_id", "ts"], "left")
    return tidy(measured.groupBy("series_id").agg(F.count("*").alias("n_past"), F.sum("raw").alias("sum_past")), 2)


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d::VARCHAR AS d, strftime(timezone('UTC', timezone('Europe/Prague', d::TIMESTAMP + INTERVAL 9 HOUR)), '%Y-%m-%d %H:%M:%S') AS cutoff FROM d""")
def wall_clock_cutoff(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return tidy(d.withColumn("cutoff", A.wall(F.col("d"), 9)))


@query("""WITH e AS (SELECT ts, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS k FROM events), r AS (SELECT DISTINCT ts::DATE AS d, k % 100 AS k FROM e)
SELECT d::VARCHAR AS d, k::BIGINT AS k, strftime(timezone('UTC', timezone('Europe/Prague', d::TIMESTAMP)) + to_minutes((15 * k)::BIGINT), '%Y-%m-%d %H:%M:%S') AS ts FROM r""")
def ordinal_positions_to_utc(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    e = e.withColumn("k", F.pmod(F.row_number().over(Window.partitionBy("d").orderBy("ts", "event_id")) - 1, F.lit(100))).select("d", "k").distinct()  # a day has 100 quarters at most
    return tidy(e.select("d", "k", A.ordinal_utc(F.col("d"), F.col("k"), 15).alias("ts")))
