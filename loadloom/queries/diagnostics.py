"""Diagnostic queries: signatures, reports of fits, events, shares, drifts, corrections, with stand-ins from the tables.

The observed series is that of daily order totals with a seasonal temperature; ``obs`` makes it in both engines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import arrays as A
from loadloom.operators import aggregates as G
from loadloom.operators import joins
from loadloom.operators import windows as W
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import backtest, correction, longterm
from loadloom.plans import fit as M
from loadloom.plans.design import NAMES
from loadloom.queries import models as Q
from loadloom.queries.base import DAILY, SOLVED, daily, query, rounded, table, tidy

TEMP = "10 - 12 * cos(2 * pi() * dayofyear(d) / 365) + n % 7"
SUN = "120 - 90 * cos(2 * pi() * dayofyear(d) / 365) + 5 * (n % 5)"
OBS = f"{DAILY}, obs AS (SELECT d, total / 1000 AS load, n, {TEMP} AS temp, {SUN} AS sun FROM daily)"
SEASON_YEAR = "(CASE WHEN month(d) <= 6 THEN year(d) - 1 ELSE year(d) END)"


def obs(spark, sf) -> DataFrame:
    rows = daily(spark, sf)
    wave = F.cos(2 * math.pi * F.dayofyear("d") / 365)
    return rows.select("d", (F.col("total") / 1000).alias("load"), "n", (10 - 12 * wave + F.col("n") % 7).alias("temp"), (120 - 90 * wave + 5 * (F.col("n") % 5)).alias("sun"))


def days() -> Window:
    """Over days: one row a day, whatever the data."""
    return Window.orderBy("d")


# Q1


@query(f"WITH {OBS} SELECT floor(temp / 2)::BIGINT * 2 AS temp_bin, count(*)::BIGINT AS n, round(avg(load), 3) AS load, round(stddev_samp(load), 3) AS sd FROM obs GROUP BY 1")
def energy_signature(spark, sf):
    """Load by temperature."""
    return tidy(obs(spark, sf).groupBy((F.floor(F.col("temp") / 2) * 2).alias("temp_bin")).agg(F.count("*").alias("n"), F.avg("load").alias("load"), F.stddev_samp("load").alias("sd")), 3)


@query(f"""WITH {OBS}, z AS (SELECT CASE WHEN temp < 12 THEN 'heating' WHEN temp <= 18 THEN 'dead band' ELSE 'cooling' END AS zone, load, temp FROM obs)
SELECT zone, count(*)::BIGINT AS n, round(avg(load), 3) AS load, round(regr_slope(load, temp), 3) AS slope, round(regr_r2(load, temp), 6) AS r2 FROM z GROUP BY 1""")
def dead_band_summary(spark, sf):
    zone = F.when(F.col("temp") < 12, "heating").when(F.col("temp") <= 18, "dead band").otherwise("cooling").alias("zone")
    found = obs(spark, sf).groupBy(zone).agg(F.count("*").alias("n"), F.avg("load").alias("load"), F.regr_slope("load", "temp").alias("slope"), F.regr_r2("load", "temp").alias("r2"))
    return found.select("zone", "n", rounded(F.col("load"), 3).alias("load"), rounded(F.col("slope"), 3).alias("slope"), rounded(F.col("r2"), 6).alias("r2"))


@query(f"""WITH {OBS} SELECT CASE month(d) // 3 % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season, (isodow(d) - 1)::BIGINT AS dow, count(*)::BIGINT AS n, round(avg(load), 3) AS load FROM obs GROUP BY ALL""")
def season_weekday_profile(spark, sf):
    number = F.floor(F.month("d") / 3) % 4
    season = F.when(number == 0, "winter").when(number == 1, "spring").when(number == 2, "summer").otherwise("autumn").alias("season")
    return tidy(obs(spark, sf).groupBy(season, F.weekday("d").alias("dow")).agg(F.count("*").alias("n"), F.avg("load").alias("load")), 3)


# Q2


@query(f"""WITH {OBS}, m AS (SELECT *, lag(temp) OVER (ORDER BY d) AS before FROM obs), mild AS (SELECT *, load - avg(load) OVER (PARTITION BY isodow(d)) AS residual FROM m WHERE temp BETWEEN 14 AND 18 AND before BETWEEN 12.5 AND 19.5)
SELECT (isodow(d) - 1)::BIGINT AS dow, count(*)::BIGINT AS n, round(avg(load), 3) AS base, round(stddev_samp(residual), 3) AS sd, round(regr_slope(residual, temp), 3) AS slope FROM mild GROUP BY 1""")
def mild_fit_report(spark, sf):
    """On mild days: a base for each weekday, the residuals' spread and their slope by temperature."""
    (low, high), (low_before, high_before) = C.BASE["mild"], C.BASE["mild_before"]
    rows = obs(spark, sf).withColumn("before", F.lag("temp").over(days())).filter(F.col("temp").between(low, high) & F.col("before").between(low_before, high_before)).withColumn("dow", F.weekday("d"))
    rows = rows.withColumn("residual", F.col("load") - F.avg("load").over(Window.partitionBy("dow")))
    return tidy(rows.groupBy("dow").agg(F.count("*").alias("n"), F.avg("load").alias("base"), F.stddev_samp("residual").alias("sd"), F.regr_slope("residual", "temp").alias("slope")), 3)


# Q3, Q4


@query(f"""WITH {OBS}, f AS (SELECT avg(load) AS m, regr_slope(load, temp) AS s, regr_intercept(load, temp) AS i FROM obs), e AS (SELECT CASE WHEN temp < 5 THEN 'cold' WHEN temp > 20 THEN 'hot' END AS side, load - m AS before, load - i - s * temp AS after FROM obs, f)
SELECT side, count(*)::BIGINT AS n, round(sqrt(avg(before * before)), 3) AS rmse_before, round(sqrt(avg(after * after)), 3) AS rmse_after FROM e WHERE side IS NOT NULL GROUP BY 1""")
def cold_and_hot_days_rmse(spark, sf):
    """Errors on cold and on hot days without and with the temperature."""
    rows = obs(spark, sf)
    fit = rows.agg(F.avg("load").alias("m"), F.regr_slope("load", "temp").alias("s"), F.regr_intercept("load", "temp").alias("i"))
    side = F.when(F.col("temp") < 5, "cold").when(F.col("temp") > 20, "hot")
    e = rows.join(F.broadcast(fit)).select(side.alias("side"), (F.col("load") - F.col("m")).alias("b"), (F.col("load") - F.col("i") - F.col("s") * F.col("temp")).alias("a"))  # one row of moments
    return tidy(e.filter("side is not null").groupBy("side").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("rmse_before"), F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rmse_after")), 3)


@query(f"""WITH {OBS}, w AS (SELECT d, avg(temp) OVER w AS temp, avg(load) OVER w AS load, count(*) OVER w AS n FROM obs WINDOW w AS (ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)), r AS (SELECT *, year(d) AS y, row_number() OVER (PARTITION BY year(d) ORDER BY temp, d) AS cold, row_number() OVER (PARTITION BY year(d) ORDER BY temp DESC, d) AS hot FROM w WHERE n = 7)
SELECT y::BIGINT AS year, CASE WHEN cold = 1 THEN 'coldest' ELSE 'hottest' END AS week, d::VARCHAR AS until, round(temp, 3) AS temp, round(load, 3) AS load FROM r WHERE cold = 1 OR hot = 1""")
def coldest_and_hottest_weeks(spark, sf):
    w = Window.orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    rows = obs(spark, sf).select("d", *(F.avg(c).over(w).alias(c) for c in ("temp", "load")), F.count("*").over(w).alias("n")).filter("n = 7").withColumn("year", F.year("d"))
    of_year = Window.partitionBy("year")
    rows = rows.withColumns({"cold": F.row_number().over(of_year.orderBy("temp", "d")), "hot": F.row_number().over(of_year.orderBy(F.desc("temp"), "d"))}).filter("cold = 1 or hot = 1")
    return tidy(rows.select("year", F.when(F.col("cold") == 1, "coldest").otherwise("hottest").alias("week"), F.col("d").alias("until"), "temp", "load"), 3)


# Q5


@query(f"""WITH {OBS}, a AS (SELECT d, load, sun - avg(sun) OVER (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS anomaly, lead(load) OVER (ORDER BY d) AS next FROM obs)
SELECT year(d)::BIGINT AS year, count(*)::BIGINT AS n, round(regr_slope(load, anomaly), 3) AS slope, round(sqrt((regr_syy(load, anomaly) - regr_sxy(load, anomaly) * regr_sxy(load, anomaly) / regr_sxx(load, anomaly)) / (count(*) - 2) / regr_sxx(load, anomaly)), 3) AS slope_se,
round(regr_slope(next, anomaly), 3) AS next_slope FROM a WHERE next IS NOT NULL GROUP BY 1 HAVING count(*) > 30""")
def sun_anomaly_response(spark, sf):
    """Stored sunshine would show on the next day: slopes on the anomaly against 15 neighbouring days, by year, with errors."""
    rows = obs(spark, sf).withColumns({"anomaly": F.col("sun") - F.avg("sun").over(days().rowsBetween(-7, 7)), "next": F.lead("load").over(days()), "year": F.year("d")}).filter("next is not null")
    found = G.regressions(rows, "load", "anomaly", ["year"]).select("year", "n", "slope", "slope_se")
    return tidy(found.join(rows.groupBy("year").agg(F.regr_slope("next", "anomaly").alias("next_slope")), "year").filter("n > 30"), 3)


# Q8


@query("""WITH e AS (SELECT ts, value, timezone('Europe/Prague', timezone('UTC', ts)) AS lt, ts + to_seconds((15.5 * 240)::BIGINT) AS sun FROM events),
c AS (SELECT 'clock' AS aligned, month(lt) AS m, hour(lt) AS h, value FROM e UNION ALL SELECT 'sun', month(lt), hour(sun), value FROM e)
SELECT aligned, h::BIGINT AS hour, count(*)::BIGINT AS n, round(avg(value), 3) AS value, round(max(value) - min(value), 3) AS spread FROM c GROUP BY ALL""")
def clock_and_sun_profiles(spark, sf):
    """Daily profile by the clock and by the sun's time of the site, with its spread."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    clock = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(C.ZONE), F.col("ts").cast("timestamp_ntz")))
    sun = F.hour(F.col("ts") + F.expr(f"interval {int(C.LONGITUDE * 240)} seconds"))
    both = e.select("value", F.inline(F.array(F.struct(F.lit("clock").alias("aligned"), clock.alias("hour")), F.struct(F.lit("sun").alias("aligned"), sun.alias("hour")))))
    return tidy(both.groupBy("aligned", "hour").agg(F.count("*").alias("n"), F.avg("value").alias("value"), (F.max("value") - F.min("value")).alias("spread")), 3)


# Q9


@query(f"""WITH {OBS}, s0 AS (SELECT year(d) AS y, isodow(d) - 1 AS dow, avg(load) AS v FROM obs GROUP BY 1, 2), s AS (SELECT y, dow, v / avg(v) OVER (PARTITION BY y) AS share FROM s0), f AS (SELECT dow, share AS was FROM s WHERE y = (SELECT min(y) FROM s))
SELECT y::BIGINT AS year, s.dow::BIGINT AS dow, round(share, 4) AS share, round(share - was, 4) AS drift FROM s JOIN f USING (dow)""")
def weekly_shape_drift(spark, sf):
    """Shape of the week in each year, relative to its mean, against the first year's."""
    rows = obs(spark, sf).groupBy(F.year("d").alias("year"), F.weekday("d").alias("dow")).agg(F.avg("load").alias("v"))
    rows = rows.withColumn("share", F.col("v") / F.avg("v").over(Window.partitionBy("year")))
    was = F.first("share").over(Window.partitionBy("dow").orderBy("year"))
    return tidy(rows.select("year", "dow", "share", (F.col("share") - was).alias("drift")))


@query(f"""WITH {OBS} SELECT {SEASON_YEAR}::BIGINT AS winter, count(*)::BIGINT AS n, round(regr_slope(load, temp), 3) AS slope, round(corr(load, temp), 6) AS correlation FROM obs WHERE month(d) IN (11, 12, 1, 2, 3) GROUP BY 1 HAVING count(*) > 20""")
def heating_slope_per_winter(spark, sf):
    winter = F.when(F.month("d") <= 6, F.year("d") - 1).otherwise(F.year("d")).alias("winter")
    found = obs(spark, sf).filter(F.month("d").isin(11, 12, 1, 2, 3)).groupBy(winter).agg(F.count("*").alias("n"), F.regr_slope("load", "temp").alias("slope"), F.corr("load", "temp").alias("correlation")).filter("n > 20")
    return found.select(F.col("winter").cast("long"), "n", rounded(F.col("slope"), 3).alias("slope"), rounded(F.col("correlation"), 6).alias("correlation"))


# Q10


@query(f"""WITH {OBS}, r AS (SELECT {SEASON_YEAR} AS season, isodow(d) AS dow, avg(load) AS usual FROM obs WHERE month(d) = 11 OR (month(d) = 12 AND day(d) < 15) GROUP BY ALL)
SELECT strftime(d, '%m-%d') AS day, o.season::BIGINT AS season, round(100 * (load / usual - 1), 3) AS deviation FROM (SELECT *, {SEASON_YEAR} AS season FROM obs) o JOIN r ON r.season = o.season AND r.dow = isodow(o.d) WHERE strftime(d, '%m-%d') >= '12-20' OR strftime(d, '%m-%d') <= '01-06'""")
def christmas_deviations(spark, sf):
    """Days around Christmas against the same weekdays of the weeks before, in per cent, season by season."""
    from loadloom.operators.calendar import season_year

    rows = obs(spark, sf).withColumns({"season": season_year(F.col("d")), "dow": F.weekday("d"), "day": F.date_format("d", "MM-dd")})
    usual = rows.filter((F.month("d") == 11) | ((F.month("d") == 12) & (F.dayofmonth("d") < 15))).groupBy("season", "dow").agg(F.avg("load").alias("usual"))
    found = rows.filter((F.col("day") >= "12-20") | (F.col("day") <= "01-06")).join(usual, ["season", "dow"])
    return tidy(found.select("day", F.col("season").cast("long"), (100 * (F.col("load") / F.col("usual") - 1)).alias("deviation")), 3)


# Q11


@query(f"""WITH {OBS}, e AS (SELECT d, load - lag(load, 7) OVER w AS err, sun - lag(sun, 1) OVER w AS outside FROM obs WINDOW w AS (ORDER BY d)), s AS (SELECT *, sum(outside * err) OVER w AS xy, sum(outside * outside) OVER w AS xx FROM e WINDOW w AS (ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 DAY PRECEDING))
SELECT year(d)::BIGINT AS year, count(*)::BIGINT AS n, round(corr(err, outside), 6) AS correlation, round(sqrt(avg(err * err)), 3) AS rmse, round(sqrt(avg((err - xy / (xx * 1.001) * outside) ** 2)), 3) AS rmse_with FROM s WHERE err IS NOT NULL AND outside IS NOT NULL AND xx > 0 AND xy IS NOT NULL GROUP BY 1""")
def outside_surprise(spark, sf):
    """A regressor from outside: its correlation with the error, and errors with its slope as known two days before."""
    rows = obs(spark, sf).select("d", (F.col("load") - F.lag("load", 7).over(days())).alias("err"), (F.col("sun") - F.lag("sun", 1).over(days())).alias("outside"), F.lit("s").alias(SERIES))
    rows = correction.online_slope(rows, "outside", "err", "d", 2).filter("err is not null and outside is not null and slope is not null")
    rest = F.col("err") - F.col("slope") * F.col("outside")
    found = rows.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"), F.corr("err", "outside").alias("correlation"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.sqrt(F.avg(rest * rest)).alias("rmse_with"))
    return found.select(F.col("year").cast("long"), "n", rounded(F.col("correlation"), 6).alias("correlation"), rounded(F.col("rmse"), 3).alias("rmse"), rounded(F.col("rmse_with"), 3).alias("rmse_with"))


# Q12


@query(f"""WITH {OBS}, w AS (SELECT d, load, min(temp) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 15 AS warm, load - avg(load) OVER (ORDER BY d ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS deviation FROM obs),
e AS (SELECT *, max(CASE WHEN warm THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM w)
SELECT datediff('day', last, d)::BIGINT AS days_after, count(*)::BIGINT AS n, round(avg(deviation), 3) AS deviation, round(stddev_pop(deviation), 3) AS sd FROM e WHERE datediff('day', last, d) BETWEEN 0 AND 6 GROUP BY 1""")
def after_warm_spells(spark, sf):
    """Deviations of the load in the days after three warm ones."""
    rows = obs(spark, sf).withColumns({"warm": F.min("temp").over(days().rowsBetween(-2, 0)) > 15, "deviation": F.col("load") - F.avg("load").over(days().rowsBetween(-15, 15))})
    rows = rows.withColumn("last", F.max(F.when(F.col("warm"), F.col("d"))).over(days().rowsBetween(Window.unboundedPreceding, 0))).withColumn("days_after", F.datediff("d", "last"))
    return tidy(rows.filter("days_after between 0 and 6").groupBy("days_after").agg(F.count("*").alias("n"), F.avg("deviation").alias("deviation"), F.stddev_pop("deviation").alias("sd")), 3)


# Q14, A22


@query("""WITH t AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderstatus AS s, o_totalprice AS p FROM orders), r AS (SELECT y, m, sum(p) AS p, sum(CASE WHEN s = 'F' THEN p ELSE 0 END) AS f FROM t GROUP BY ROLLUP (y, m))
SELECT coalesce(y::VARCHAR, 'all') AS year, coalesce(m::VARCHAR, 'all') AS month, round(p, 2) AS total, round(100 * f / p, 3) AS share FROM r""")
def cleaned_history_shares(spark, sf):
    """Totals of months, years and all, with a component's share in per cent."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_totalprice").alias("p"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("f"))
    r = o.rollup("y", "m").agg(F.sum("p").alias("p"), F.sum("f").alias("f"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all"))
    return r.select(name("y").alias("year"), name("m").alias("month"), rounded(F.col("p"), 2).alias("total"), rounded(100 * F.col("f") / F.col("p"), 3).alias("share"))


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, grouping(o_orderstatus)::BIGINT AS g_status, grouping(o_orderpriority)::BIGINT AS g_priority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_totals(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice").cube("status", "priority")
    return tidy(o.agg(F.grouping("status").alias("g_status"), F.grouping("priority").alias("g_priority"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("""SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS segment, count(*)::BIGINT AS n, round(avg(c_acctbal), 3) AS balance FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())""")
def grouping_set_totals(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    found = c.groupingSets([["nation"], ["segment"], []], "nation", "segment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))
    return tidy(found, 3)


@query("""SELECT c_custkey::BIGINT AS c_custkey, ntile(10) OVER w AS tile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, round(first_value(c_acctbal) OVER w, 2) AS least, rank() OVER w AS place
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def ranks(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    c = table(spark, sf, "customer")
    found = c.select("c_custkey", F.ntile(10).over(w).cast("long").alias("tile"), rounded(F.percent_rank().over(w), 6).alias("percent_rank"), rounded(F.cume_dist().over(w), 6).alias("cume_dist"), rounded(F.first("c_acctbal").over(w), 2).alias("least"), F.rank().over(w).cast("long").alias("place"))
    return found


# Q18


@query("""WITH s AS (SELECT c_mktsegment AS component, o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
w AS (SELECT component, d, avg(v) OVER w AS week, count(*) OVER w AS n, v - lag(v) OVER (PARTITION BY component ORDER BY d) AS rise FROM s WINDOW w AS (PARTITION BY component ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)),
b AS (SELECT component, d, week, row_number() OVER (PARTITION BY component ORDER BY week DESC, d) AS k FROM w WHERE n = 7), r AS (SELECT component, d, rise, row_number() OVER (PARTITION BY component ORDER BY rise DESC, d) AS k FROM w WHERE rise IS NOT NULL)
SELECT b.component, b.d::VARCHAR AS best_week_until, round(week, 2) AS week_mean, r.d::VARCHAR AS steepest_day, round(rise, 2) AS rise FROM b JOIN r ON r.component = b.component AND b.k = 1 AND r.k = 1""")
def best_weeks_of_components(spark, sf):
    """The strongest week of each component and its steepest rise."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    s = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("component"), F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    of = Window.partitionBy("component")
    w = of.orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    rows = s.select("component", "d", F.avg("v").over(w).alias("week"), F.count("*").over(w).alias("n"), (F.col("v") - F.lag("v").over(of.orderBy("d"))).alias("rise"))
    best = W.keep_first(rows.filter("n = 7").select("component", "d", "week"), ["component"], F.struct(-F.col("week"), "d"))
    steep = W.keep_first(rows.filter("rise is not null").select("component", "d", "rise"), ["component"], F.struct(-F.col("rise"), "d"))
    return tidy(best.select("component", F.col("d").alias("best_week_until"), F.col("week").alias("week_mean")).join(steep.select("component", F.col("d").alias("steepest_day"), "rise"), "component"), 2)


# Joins and sampling


@query("""SELECT p.event_id::BIGINT AS purchase, count(e.event_id)::BIGINT AS n_errors, round(avg(e.value), 4) AS value FROM events p LEFT JOIN events e ON e.event_type = 'error' AND e.ts > p.ts - INTERVAL 30 MINUTE AND e.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1""")
def interval_join(spark, sf):
    """Purchases with the errors of the half hour before: a range join as equalities of time buckets."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    left, right = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "ts"), e.filter("event_type = 'error'").select(F.col("ts").alias("at"), "value")
    met = joins.within_before(left, right, "ts", "at", 1800)
    return tidy(left.join(met.groupBy("purchase").agg(F.count("*").alias("n_errors"), F.avg("value").alias("value")), "purchase", "left").select("purchase", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "value"))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, md5(o_orderkey::VARCHAR) AS place FROM orders ORDER BY 2, 1 LIMIT 600")
def hashed_sample(spark, sf):
    """A sample of fixed size, the same at every run."""
    o = table(spark, sf, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("place"))
    return o.orderBy("place", "o_orderkey").limit(600)


# E23, E24, C10

HOURLY_ERRORS = """g AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1), er AS (SELECT a.ts, a.ts::DATE AS d, hour(a.ts) AS tod, a.v - b.v AS error FROM g a JOIN g b ON b.ts = a.ts - INTERVAL 1 DAY)"""
FEATURE_SQL = f"""{HOURLY_ERRORS}, dd AS (SELECT d, avg(error) AS mean, avg(CASE WHEN tod < 9 THEN error END) AS morning FROM er GROUP BY 1),
x1 AS (SELECT (d + 2)::DATE AS d, mean AS x1 FROM dd), x2 AS (SELECT (d + 1)::DATE AS d, morning AS x2 FROM dd),
dev AS (SELECT er.d, tod, error - mean AS dev FROM er JOIN dd ON dd.d = er.d), m AS (SELECT (d + 2)::DATE AS d, tod, CASE WHEN count(dev) OVER w >= 5 THEN avg(dev) OVER w END AS m FROM dev WINDOW w AS (PARTITION BY tod ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
x3 AS (SELECT d, tod, last_value(m IGNORE NULLS) OVER (PARTITION BY tod ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x3 FROM m),
ft AS (SELECT er.d, er.tod, error, x1, x2, x3 FROM er LEFT JOIN x1 ON x1.d = er.d LEFT JOIN x2 ON x2.d = er.d LEFT JOIN x3 ON x3.d = er.d AND x3.tod = er.tod)"""


def hourly_errors(spark, sf) -> DataFrame:
    """Errors of the forecast 'as a day before', by the hour."""
    g = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.avg("value").alias("v"))
    was = g.select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.col("v").alias("was"))
    return g.join(was, "ts").select(F.lit("events").alias(SERIES), F.to_date("ts").alias("date_local"), F.hour("ts").cast("double").alias("tod"), (F.col("v") - F.col("was")).alias("error"))


def regular(spark, rows: DataFrame) -> DataFrame:
    """A calendar without irregular days."""
    return rows.select(F.col("date_local").alias("date")).distinct().withColumn("irregular", F.lit(False))


@query(f"WITH {FEATURE_SQL} SELECT d::VARCHAR AS d, tod::DOUBLE AS tod, round(x1, 4) AS x1, round(x2, 4) AS x2, round(x3, 4) AS x3 FROM ft")
def day_ahead_features(spark, sf):
    """What a day-ahead correction knows: the mean error of two days before, of the morning of the day before, and the slot's usual deviation."""
    rows = hourly_errors(spark, sf)
    return tidy(correction.day_ahead_features(rows, regular(spark, rows)).select(F.col("date_local").alias("d"), "tod", "x1", "x2", "x3"))


@query(f"WITH {FEATURE_SQL}, {SOLVED.format(least=7)} SELECT ft.d::VARCHAR AS d, tod::DOUBLE AS tod, round(c1, 5) AS c1, round(c1*x1 + c2*x2 + c3*x3, 4) AS correction FROM ft LEFT JOIN co ON co.d = ft.d")
def day_ahead_correction(spark, sf):
    """Ridge regression on the days known at each issue; the twin solves it by Cramer's rule."""
    rows = hourly_errors(spark, sf)
    found = correction.online(correction.day_ahead_features(rows, regular(spark, rows)), ["x1", "x2", "x3"], "error", "date_local", delay=2, warm_up=7)
    return found.select(F.col("date_local").cast("string").alias("d"), "tod", rounded(F.col("coef_x1"), 5).alias("c1"), rounded(F.col("correction"), 4).alias("correction"))


@query("""WITH g AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1), h AS (SELECT unnest([0, 1, 3, 6, 12, 24]) AS h),
c AS (SELECT s.ts AS s, h, s.ts + to_hours(h::BIGINT) AS target, t.v - s.v AS error FROM g s, h JOIN g t ON t.ts = s.ts + to_hours(h::BIGINT))
SELECT h::BIGINT AS h, isodow(target) >= 6 AS irregular, count(*)::BIGINT AS n, round(sqrt(avg(error * error)), 4) AS rmse FROM c GROUP BY ALL""")
def irregular_targets(spark, sf):
    """Issues and horizons by whether the target's day is a day off."""
    g = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.avg("value").alias("v"))
    laid = g.select("v", F.explode(F.array(*map(F.lit, (0, 1, 3, 6, 12, 24)))).alias("h"), "ts").select("h", "v", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("h") * 3600).alias("target"))
    met = laid.join(g.select(F.col("ts").alias("target"), F.col("v").alias("actual")), "target")
    e = F.col("actual") - F.col("v")
    return tidy(met.groupBy("h", (F.weekday("target") >= 5).alias("irregular")).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")))


# On the series with known truth


@query()
def gamma_profile(spark, sf):
    """Q13: the fit's error over pinned losses of generation by heat; every value is a fold of one scan."""
    grid = [round(0.002 * k, 3) for k in range(0, 16)]
    at = NAMES.index("gamma")
    params = Q.hourly_fit(spark, sf).select(SERIES, F.col("theta").alias("_t"), F.explode(F.array(*map(F.lit, grid))).alias("gamma"))
    theta = F.transform("_t", lambda x, i: F.when(i == at, F.col("gamma")).otherwise(x))
    now = M.start(params, Q.LAYOUT, columns={"fold": F.col("gamma").cast("string"), "theta": theta})
    found = M.linear(None, Q.LAYOUT, 1.0, now, Q.hour_chunks(spark, sf))
    return found.select(SERIES, F.col("fold").cast("double").alias("gamma"), "n", "rmse")


@query()
def lag_response(spark, sf):
    """Q3: how the load without base, cooling and generation answers the temperature of the last four days, hour by hour, smoothed by second
    differences."""
    told = M.predict(Q.hour_chunks(spark, sf), Q.hourly_fit(spark, sf), Q.LAYOUT, 1.0)
    rest = told.select(SERIES, "ts", "temp", (F.col("load") - F.col("base") - F.col("cooling") + F.col("pv")).alias("rest"))
    return lag_irf(rest.filter(F.month("ts").isin(11, 12, 1, 2)), "temp", "rest", 96)


def lag_irf(rows: DataFrame, x: str, y: str, most: int, every: int = 6, penalty: float = 1e3) -> DataFrame:
    """Responses to the means of ``every`` rows of x, up to ``most`` rows back, by penalised least squares from moments."""
    w = Window.partitionBy(SERIES).orderBy("ts")
    n = most // every
    lagged = {f"_x{k}": F.avg(x).over(w.rowsBetween(-every * (k + 1) + 1, -every * k)) for k in range(n)}
    used = rows.withColumns(lagged | {"_place": F.row_number().over(w)}).filter(F.col("_place") > most)
    names = [*lagged, "_one", "_y"]
    used = used.withColumns({"_one": F.lit(1.0), "_y": F.col(y)})
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = used.groupBy(SERIES).agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    g[i, j] = g[j, i] = row[f"g{i}_{j}"]
                d2 = np.diff(np.eye(n), 2, axis=0)
                a = g[: n + 1, : n + 1].copy()
                a[:n, :n] += penalty * (d2.T @ d2)
                c = np.linalg.solve(a, g[: n + 1, -1])
                out += [(row[SERIES], k * every, float(c[k])) for k in range(n)]
            yield pd.DataFrame(out, columns=[SERIES, "lag", "response"])

    return moments.mapInPandas(solve, f"{SERIES} string, lag int, response double")


@query()
def response_curves(spark, sf):
    """E3, E4, E39: heating and cooling by temperature, daily profiles of a workday, capacity and heating increment over time."""

    def run(batches):
        for pdf in batches:
            for series, theta, coef in zip(pdf[SERIES], pdf["theta"], pdf["coef"], strict=True):
                yield pd.DataFrame(curves(dict(zip(NAMES, theta, strict=True)), np.array(coef), Q.LAYOUT), columns=["curve", "x", "value"]).assign(**{SERIES: series})[[SERIES, "curve", "x", "value"]]

    return Q.fitted(spark, sf).select(SERIES, "theta", "coef").mapInPandas(run, f"{SERIES} string, curve string, x double, value double")


def curves(q: dict[str, float], coef: np.ndarray, layout) -> list[tuple[str, float, float]]:
    s, temps, tod, days_ = layout.slices, np.arange(-15.0, 36.0), np.arange(0, 24, 0.25), np.arange(0.0, layout.span_days, 30.0)
    heat = A.softplus(q["t_b"] - temps, q["s"]) / np.maximum(1 + q["alpha"] * temps, C.HEATING["cop_floor"])
    cool = A.softplus(temps - q["t_bc"], q["s_c"]) / np.maximum(1 - q["alpha_c"] * (temps - C.COOLING["reference"]), C.COOLING["eer_floor"])
    waves = np.hstack([np.ones((len(tod), 1)), A.fourier(tod, C.HEATING["harmonics"])])
    k_heat, k_cool = (waves @ coef[s[n]][: waves.shape[1]] for n in ("heating", "cooling"))
    ramps = A.ramps(days_, layout.span_days, layout.n_ramps)
    trend = coef[s["trend"]].reshape(-1, layout.n_ramps)[0] if layout.n_ramps else np.zeros(0)
    tables = {
        "heating by temperature": (temps, heat * k_heat.mean()), "cooling by temperature": (temps, cool * k_cool.mean()), "heating by time": (tod, k_heat), "cooling by time": (tod, k_cool),
        "level": (days_, A.level_basis(days_, layout.span_days) @ coef[s["level"]]), "profile": (tod, A.fourier(tod, C.BASE["profile"]) @ coef[s["dt0"]]), "morning": (tod, A.night_basis(tod) @ coef[s["morning"]]),
        "lighting": (tod, A.light_basis(tod) @ coef[s["light"]]), "gloom": (tod, A.window_basis(tod, *C.GLOOM_WINDOW, C.GLOOM_KNOT) @ coef[s["gloom"]]),
        "capacity": (days_, ramps @ coef[s["pv"]]), "heating increment": (days_, ramps[:, 1:] @ trend),
    }
    return [(name, float(x), float(v)) for name, (xs, vs) in tables.items() for x, v in zip(xs, vs, strict=True)]


#: Where the validation stands, and its cases of weather and trend.
CUTOFFS = ("2023-01-01", "2023-03-01", "2023-05-01")
LEVEL, OTHERS = "heating:0,pv:0", "level:0"
CASES = [("given", "hold"), ("given", "last"), ("given", LEVEL), ("given", OTHERS), ("given", "level:0.5,heating:0.5,pv:0.5"), ("normal", "last"), ("scenarios", "last"), ("normal", OTHERS), ("scenarios", OTHERS)]


@query()
def forward_validation(spark, sf):
    """Q17: up to a year ahead from three cutoffs, each from what was known at it, under nine rules of trend and weather, against what came; the
    share in the band, whose width is the error at the other cutoffs."""
    at = F.col("fold").cast("timestamp")
    folds = table(spark, sf, "region").select(F.col("r_name").alias(SERIES)).distinct().select(SERIES, F.explode(F.array(*map(F.lit, CUTOFFS))).alias("fold"))
    start = M.start(folds, Q.LAYOUT, columns={"fold": F.col("fold"), "span": F.datediff("fold", F.lit(Q.FIRST)), "until": F.unix_timestamp(at)})
    params = Q.kept(spark, sf, "forward-fits", lambda: M.from_scratch(None, Q.LAYOUT, 1.0, passes=4, params=start, chunks=Q.hour_chunks(spark, sf)))
    rows = Q.hours(spark, sf).filter("ts < '2023-12-30'")
    found = Q.kept(spark, sf, "forward-cases", lambda: longterm.forward(rows, params.withColumn("cutoff", at), Q.LAYOUT, 1.0, CASES))
    return longterm.judged(found).withColumn("cutoff", F.date_format("cutoff", "yyyy-MM-dd"))


@query()
def training_on_forecasts(spark, sf):
    """Q20: day-ahead errors with forecast weather, of fits on measured and of fits on forecast weather (a hot bias by the hour and noise)."""
    from loadloom.plans import synthetic
    from loadloom.plans.chunks import chunked

    rows = Q.hours(spark, sf)
    noisy = lambda salt: synthetic.noise(F.col(SERIES), F.unix_timestamp("ts"), salt)
    forecast = rows.select(SERIES, "ts", (F.col("temp") + 1 + 0.5 * F.cos(F.col("tod") * (2 * math.pi / 24)) + noisy(21)).alias("temp"), (F.col("sun") * (1 + 0.2 * noisy(22))).alias("sun"), F.greatest(F.col("wind") + noisy(23), F.lit(0.0)).alias("wind"), "gloom")
    bias = correction.bias_history(rows.select(SERIES, "ts", "temp").join(forecast.select(SERIES, "ts", F.col("temp").alias("fc")), [SERIES, "ts"]), "fc", "temp").select(SERIES, F.col("d").alias("date_local"), F.col("h").cast("double").alias("tod"), "bias")
    debiased = forecast.join(rows.select(SERIES, "ts", "date_local", "tod"), [SERIES, "ts"]).join(bias, [SERIES, "date_local", "tod"], "left").withColumn("temp", F.col("temp") - F.coalesce("bias", F.lit(0.0))).select(SERIES, "ts", "temp", "sun", "wind", "gloom")
    issues = backtest.shape_days(Q.issues(spark, sf).select(SERIES, "issue").filter("issue >= '2023-11-01'"), every=400)
    measured, out = rows, None
    for name, known, told in (("measured, raw forecast", measured, forecast), ("measured, debiased forecast", measured, debiased), ("forecast, raw forecast", None, forecast), ("forecast, debiased forecast", None, debiased)):
        base = rows if known is not None else rows.drop("temp", "sun", "wind", "gloom").join(told, [SERIES, "ts"])
        chunks = chunked(base, "training-chunks", forecast=told)
        days_ = issues.groupBy(SERIES).agg(F.min("day").alias("day"))
        shapes = backtest.weekly_shapes(chunks, days_, Q.LAYOUT, 1.0, passes=5)
        found = backtest.rolling(chunks, issues, shapes, Q.LAYOUT, 1.0)
        row = G.scores(found, "load", "model", [SERIES]).withColumn("training", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


