"""Window and sequence operators, online estimators, climatology and scenarios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadloom.operators import windows as W
from loadloom.plans import correction, scenario
from loadloom.queries.base import AXIS, DAILY, QUARTER, SOLVED, STAMP, daily, filled, quarter, query, rounded, table, tidy


@query(f"""WITH RECURSIVE {AXIS}, n AS (SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM bothways),
e AS (SELECT series_id, k, ts, value AS y FROM n WHERE k = 1 UNION ALL SELECT n.series_id, n.k, n.ts, (1 - 0.0625) * e.y + 0.0625 * n.value FROM e JOIN n ON n.series_id = e.series_id AND n.k = e.k + 1)
SELECT series_id, {STAMP} AS ts, round(y, 4) AS ema FROM e""")
def ema_scan(spark, sf):
    """Recursive exponential filter over the whole axis."""
    return tidy(W.ema(filled(spark, sf), "value", 0.0625, "ema").select("series_id", "ts", "ema"))


@query(f"""WITH {DAILY} SELECT d::VARCHAR AS d, round(total, 2) AS total, round(lag(total, 1) OVER w, 2) AS lag1, round(lag(total, 7) OVER w, 2) AS lag7, round(lead(total, 2) OVER w, 2) AS lead2 FROM daily WINDOW w AS (ORDER BY d)""")
def lag_lead(spark, sf):
    w = Window.orderBy("d")  # one row a day
    return tidy(daily(spark, sf).select("d", "total", F.lag("total", 1).over(w).alias("lag1"), F.lag("total", 7).over(w).alias("lag7"), F.lead("total", 2).over(w).alias("lead2")), 2)


@query(f"WITH {QUARTER} SELECT series_id, {STAMP} AS ts, " + ", ".join(f"round(lag(value, {k}) OVER w, 4) AS value_lag{k}" for k in range(0, 9)) + " FROM q WINDOW w AS (PARTITION BY series_id ORDER BY ts)")
def lag_matrix(spark, sf):
    return tidy(W.lags(quarter(spark, sf), "value", list(range(9))).drop("value"))


@query(f"WITH {QUARTER} SELECT series_id, {STAMP} AS ts, round(avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS by_rows, round(avg(value) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING), 4) AS by_time FROM q")
def rolling_centered(spark, sf):
    return tidy(quarter(spark, sf).select("series_id", "ts", W.rolling("value", 3, 3).alias("by_rows"), W.rolling_seconds("value", 21600, 21600).alias("by_time")))


@query(f"""WITH {DAILY} SELECT d::VARCHAR AS d, CASE WHEN count(total) OVER w7 >= 5 THEN round(avg(total) OVER w7, 2) END AS week, CASE WHEN count(total) OVER w30 >= 7 THEN round(avg(total) OVER w30, 2) END AS month FROM daily
WINDOW w7 AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_minperiods(spark, sf):
    one = daily(spark, sf).withColumn("series_id", F.lit("orders"))
    return tidy(one.select("d", W.rolling("total", 6, 0, 5, order="d").alias("week"), W.rolling("total", 29, 0, 7, order="d").alias("month")), 2)


@query(f"""WITH {DAILY} SELECT d::VARCHAR AS d, round(last_value(CASE WHEN isodow(d) < 6 THEN total END IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS last_workday FROM daily""")
def ffill_masked(spark, sf):
    one = daily(spark, sf).withColumn("series_id", F.lit("orders"))
    return tidy(one.select("d", W.forward_fill(F.when(F.weekday("d") < 5, F.col("total")), order="d").alias("last_workday")), 2)


@query(f"""WITH {DAILY}, e AS (SELECT d, CASE WHEN month(d) IN (6, 7, 8) OR (total > 900000 AND lag(total) OVER (ORDER BY d) > 900000) THEN 0 WHEN total < 700000 AND lag(total) OVER (ORDER BY d) < 700000 THEN 1 END AS ev FROM daily)
SELECT d::VARCHAR AS d, coalesce(last_value(ev IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS state FROM e""")
def hysteresis_state(spark, sf):
    """On after two low days, off after two high days and in summer."""
    w = Window.partitionBy("series_id").orderBy("d")
    one = daily(spark, sf).withColumn("series_id", F.lit("orders")).withColumn("before", F.lag("total").over(w))
    on, off = F.expr("total < 700000 and before < 700000"), F.expr("month(d) in (6, 7, 8) or (total > 900000 and before > 900000)")
    return tidy(one.select("d", W.hysteresis(on, off, order="d").alias("state")))


@query("""WITH c AS (SELECT least(dayofyear(l_shipdate), 365) AS doy, avg(l_quantity) AS v FROM lineitem GROUP BY 1), o AS (SELECT unnest(generate_series(-7, 7)) AS o),
s AS (SELECT ((doy - 1 + o + 365) % 365) + 1 AS doy, v FROM c, o) SELECT doy::BIGINT AS doy, round(avg(v), 4) AS smooth FROM s GROUP BY 1""")
def circular_climatology(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.least(F.dayofyear("l_shipdate"), F.lit(365)).alias("doy")).agg(F.avg("l_quantity").alias("v"))
    return tidy(W.circular_mean(c, "v", "doy", 365, 7, [], "smooth"))


@query(f"""WITH {QUARTER} SELECT series_id, ts::DATE::VARCHAR AS d, (row_number() OVER (PARTITION BY series_id, ts::DATE ORDER BY ts) - 1)::BIGINT AS position, round(value / avg(value) OVER (PARTITION BY series_id, ts::DATE), 4) AS relative FROM q""")
def cumcount_and_relative(spark, sf):
    day = Window.partitionBy("series_id", "d")
    q = quarter(spark, sf).withColumn("d", F.to_date("ts"))
    return tidy(q.select("series_id", "d", (F.row_number().over(day.orderBy("ts")) - 1).alias("position"), (F.col("value") / F.avg("value").over(day)).alias("relative")))


@query(f"""WITH {QUARTER}, o AS (SELECT 86400 * (d + 1) + 900 * s AS o FROM (SELECT unnest(generate_series(0, 6)) AS d), (SELECT unnest(generate_series(0, 3)) AS s)),
laid AS (SELECT series_id, ts + to_seconds(o) AS ts, value FROM q, o), m AS (SELECT series_id, ts, avg(value) AS history FROM laid GROUP BY 1, 2)
SELECT q.series_id, strftime(q.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(history, 4) AS history FROM q LEFT JOIN m ON m.series_id = q.series_id AND m.ts = q.ts""")
def same_slot_history(spark, sf):
    return tidy(W.same_slot_history(quarter(spark, sf), "value", 7).select("series_id", "ts", "history"))


DEBIAS = """e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS actual, avg(user_id * 1.0) AS fc FROM events GROUP BY 1, 2)"""


def _forecast(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("actual"), F.avg(F.col("user_id") * 1.0).alias("fc"))


@query(f"""WITH {DEBIAS}, b AS (SELECT series_id, hour(timezone('Europe/Prague', timezone('UTC', ts))) AS h, avg(fc - actual) AS bias FROM e WHERE ts < TIMESTAMP '2024-01-25' AND ts >= TIMESTAMP '2024-01-25' - INTERVAL 20 DAY GROUP BY ALL)
SELECT e.series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(greatest(fc - coalesce(bias, 0), 0), 4) AS fc FROM e LEFT JOIN b ON b.series_id = e.series_id AND b.h = hour(timezone('Europe/Prague', timezone('UTC', ts))) WHERE ts >= TIMESTAMP '2024-01-25'""")
def debias_hour(spark, sf):
    found = correction.debias(_forecast(spark, sf), "fc", "actual", F.lit("2024-01-25 00:00:00").cast("timestamp"), 20, floor=0.0)
    return tidy(found.filter("ts >= timestamp'2024-01-25'").select("series_id", "ts", "fc"))


@query(f"""WITH {DEBIAS}, d AS (SELECT series_id, timezone('Europe/Prague', timezone('UTC', ts))::DATE AS d, hour(timezone('Europe/Prague', timezone('UTC', ts))) AS h, avg(fc - actual) AS err FROM e GROUP BY ALL),
w AS (SELECT *, avg(err) OVER w AS m, count(err) OVER w AS n FROM d WINDOW w AS (PARTITION BY series_id, h ORDER BY d RANGE BETWEEN INTERVAL 31 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING))
SELECT series_id, d::VARCHAR AS d, h::BIGINT AS h, round(CASE WHEN n >= 7 THEN m ELSE 0 END, 4) AS bias FROM w""")
def debias_history(spark, sf):
    return tidy(correction.bias_history(_forecast(spark, sf), "fc", "actual").select("series_id", "d", "h", "bias"))


@query(f"""WITH {DAILY}, o AS (SELECT d, n * 1.0 AS a, total / 1000 AS b, lead(total) OVER (ORDER BY d) / 1000 AS y FROM daily)
SELECT d::VARCHAR AS d, round(sum(a * a) OVER w, 2) AS g_0_0, round(sum(a * b) OVER w, 2) AS g_0_1, round(sum(b * b) OVER w, 2) AS g_1_1, round(sum(a * y) OVER w, 2) AS c_0, round(sum(b * y) OVER w, 2) AS c_1, count(y) OVER w AS known
FROM o WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)""")
def running_moments(spark, sf):
    """What an online regression knows at each day: sums of products up to two days before."""
    rows = daily(spark, sf).select(F.lit("orders").alias("series_id"), "d", (F.col("n") * 1.0).alias("a"), (F.col("total") / 1000).alias("b"), (F.lead("total").over(Window.orderBy("d")) / 1000).alias("y"))
    return tidy(W.running_moments(rows, ["a", "b"], "y", ["series_id"], "d", 2).drop("series_id", "a", "b", "y"), 2)


@query(f"""WITH {DAILY}, e AS (SELECT b.d, b.total - a.total AS y, lag(b.total - a.total) OVER (ORDER BY b.d) AS x FROM daily a JOIN daily b ON b.d = a.d + 7)
SELECT d::VARCHAR AS d, round(sum(x * y) OVER w / nullif(sum(x * x) OVER w * 1.001, 0), 4) AS slope FROM e WINDOW w AS (ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 DAY PRECEDING)""")
def online_ridge_1d(spark, sf):
    d = daily(spark, sf).select("d", "total")
    e = d.join(d.select(F.date_add("d", 7).alias("d"), F.col("total").alias("pred")), "d").select("d", (F.col("total") - F.col("pred")).alias("y"))
    e = e.withColumn("x", F.lag("y").over(Window.orderBy("d")))
    return tidy(correction.online_slope(e.withColumn("series_id", F.lit("orders")), "x", "y", "d", 2).select("d", "slope"))


@query(f"""WITH {DAILY}, e AS (SELECT b.d, b.total - a.total AS error FROM daily a JOIN daily b ON b.d = a.d + 364),
ft AS (SELECT d, error, lag(error, 2) OVER w AS x1, lag(error, 1) OVER w AS x2, avg(error) OVER (ORDER BY d ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) AS x3 FROM e WINDOW w AS (ORDER BY d)), {SOLVED.format(least=21)}
SELECT ft.d::VARCHAR AS d, round(c1, 5) AS c1, round(c2, 5) AS c2, round(c3, 5) AS c3, round(c1*x1 + c2*x2 + c3*x3, 2) AS correction FROM ft LEFT JOIN co ON co.d = ft.d""")
def online_correction(spark, sf):
    """Three-feature day-ahead correction estimated from the days known at each issue; the twin solves it by Cramer's rule."""
    d = daily(spark, sf).select("d", "total")
    e = d.join(d.select(F.date_add("d", 364).alias("d"), F.col("total").alias("pred")), "d").select(F.lit("orders").alias("series_id"), "d", (F.col("total") - F.col("pred")).alias("error"))
    w = Window.partitionBy("series_id").orderBy("d")
    f = e.withColumns({"x1": F.lag("error", 2).over(w), "x2": F.lag("error", 1).over(w), "x3": F.avg("error").over(w.rowsBetween(-8, -2))})
    found = correction.online(f, ["x1", "x2", "x3"], "error", "d", delay=2, warm_up=21)
    return found.select(F.col("d").cast("string").alias("d"), *(rounded(F.col(f"coef_x{i}"), 5).alias(f"c{i}") for i in (1, 2, 3)), rounded(F.col("correction"), 2).alias("correction"))


@query(f"""WITH {DAILY}, s AS (SELECT unnest([-728, -371, -364, -357, 364, 371]) AS shift), x AS (SELECT a.d + shift::INT AS d, shift, a.total FROM daily a, s), m AS (SELECT d, avg(total) AS mean, quantile_cont(total, 0.1) AS lo, quantile_cont(total, 0.9) AS hi, min(total) AS least, max(total) AS most, count(*) AS n FROM x GROUP BY 1)
SELECT m.d::VARCHAR AS d, n::BIGINT AS n, round(mean, 2) AS mean, round(mean - sqrt(pow(mean - CASE WHEN n < 4 THEN least ELSE lo END, 2) + pow(1.2816::DOUBLE * 15, 2)), 2) AS low, round(mean + sqrt(pow(CASE WHEN n < 4 THEN most ELSE hi END - mean, 2) + pow(1.2816::DOUBLE * 15, 2)), 2) AS high FROM m WHERE n >= 2""")
def scenario_band(spark, sf):
    d = daily(spark, sf).select(F.lit("orders").alias("series_id"), F.col("d").alias("ts"), F.col("total").alias("pred"))
    shifted = d.select("series_id", F.explode(F.array(*map(F.lit, [-728, -371, -364, -357, 364, 371]))).alias("shift"), "ts", "pred").select("series_id", "shift", F.date_add("ts", F.col("shift")).alias("ts"), "pred")
    return tidy(scenario.band(shifted, "pred", 15.0, least=4).filter("n >= 2").select(F.col("ts").alias("d"), "n", "mean", "low", "high"), 2)


@query(f"""WITH {DAILY}, s AS (SELECT unnest([-364, 0, 364]) AS shift), x AS (SELECT a.d + shift::INT AS d, shift, a.total FROM daily a, s), m AS (SELECT strftime(d, '%Y-%m') AS month, shift, avg(total) AS v FROM x GROUP BY 1, 2)
SELECT month, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.1), 2) AS q10, round(quantile_cont(v, 0.9), 2) AS q90 FROM m GROUP BY 1""")
def monthly_scenarios(spark, sf):
    d = daily(spark, sf).select("d", F.explode(F.array(*map(F.lit, [-364, 0, 364]))).alias("shift"), "total").select(F.date_add("d", F.col("shift")).alias("ts"), "shift", F.col("total").alias("pred"))
    return tidy(scenario.monthly(d, "pred").select("month", "mean", "q10", "q90"), 2)


@query(f"""WITH {AXIS}, c AS (SELECT series_id, least(dayofyear(ts), 365) AS doy, hour(ts) * 4 + minute(ts) // 15 AS slot, avg(value) AS v FROM f GROUP BY ALL),
g AS (SELECT s.series_id, d.doy, x.slot FROM (SELECT DISTINCT series_id FROM c) s, (SELECT DISTINCT doy FROM c) d, (SELECT unnest(generate_series(0, 95)) AS slot) x)
SELECT g.series_id, g.doy::BIGINT AS doy, count(v)::BIGINT AS n, round(avg(v), 4) AS mean FROM g LEFT JOIN c ON c.series_id = g.series_id AND c.doy = g.doy AND c.slot = g.slot GROUP BY 1, 2""")
def climatology_coverage(spark, sf):
    c = scenario.climatology_cells(quarter(spark, sf), ["value"]).filter("n > 0")
    return tidy(c.groupBy("series_id", "doy").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))
