"""Filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadloom.operators import aggregates as G
from loadloom.operators import windows as W
from loadloom.queries.base import DAILY, QUARTER, daily, quarter, query, rounded, table, tidy


@query(f"""WITH {DAILY}, m AS (SELECT d, total, n, lag(total) OVER (ORDER BY d) AS before FROM daily)
SELECT d::VARCHAR AS d, round(total, 2) AS total FROM m WHERE n >= 4 AND total BETWEEN 500000 AND 1500000 AND before BETWEEN 400000 AND 1800000""")
def mild_days(spark, sf):
    """Days in a band whose previous day lies in a wider one, with enough rows."""
    d = daily(spark, sf).withColumn("before", F.lag("total").over(Window.orderBy("d")))  # one row a day
    return tidy(d.filter("n >= 4 and total between 500000 and 1500000 and before between 400000 and 1800000").select("d", "total"), 2)


@query(f"WITH {QUARTER}, m AS (SELECT *, avg(value) OVER (PARTITION BY series_id, ts::DATE) AS day_mean FROM q) SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value - day_mean, 4) AS deviation FROM m WHERE day_mean <= 50")
def daily_mean_filter(spark, sf):
    w = Window.partitionBy("series_id", F.to_date("ts"))
    q = quarter(spark, sf).withColumn("day_mean", F.avg("value").over(w)).filter("day_mean <= 50")
    return tidy(q.select("series_id", "ts", (F.col("value") - F.col("day_mean")).alias("deviation")))


@query("""SELECT series_id, count(*)::BIGINT AS n FROM (SELECT event_type AS series_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY AND hour(ts) BETWEEN 6 AND 18 AND isodow(ts) <= 5) GROUP BY 1""")
def recent_daytime_workdays(spark, sf):
    e = table(spark, sf, "events")
    e = e.filter((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & F.hour("ts").between(6, 18) & (F.weekday("ts") < 5))
    return tidy(e.groupBy(F.col("event_type").alias("series_id")).agg(F.count("*").alias("n")))


@query(f"""WITH {QUARTER}, v AS (SELECT * FROM q WHERE series_id = 'view'), p AS (SELECT * FROM q WHERE series_id = 'purchase')
SELECT strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(v.value, 4) AS view, round(p.value, 4) AS purchase FROM v JOIN p ON p.ts = v.ts""")
def join_inner_on_ts(spark, sf):
    q = quarter(spark, sf)
    of = lambda s: q.filter(F.col("series_id") == s).select("ts", F.col("value").alias(s))
    return tidy(of("view").join(of("purchase"), "ts"))


@query(f"""WITH {QUARTER}, v AS (SELECT * FROM q WHERE series_id = 'view'), p AS (SELECT * FROM q WHERE series_id = 'purchase')
SELECT strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(p.value, v.value), 4) AS value, p.value IS NULL AS from_measured FROM v LEFT JOIN p ON p.ts = v.ts""")
def join_left_coalesce(spark, sf):
    q = quarter(spark, sf)
    of = lambda s: q.filter(F.col("series_id") == s).select("ts", F.col("value").alias(s))
    j = of("view").join(of("purchase"), "ts", "left")
    return tidy(j.select("ts", F.coalesce("purchase", "view").alias("value"), F.col("purchase").isNull().alias("from_measured")))


@query(f"""WITH {QUARTER}, v AS (SELECT * FROM q WHERE series_id = 'view'), p AS (SELECT * FROM q WHERE series_id = 'error')
SELECT strftime(coalesce(v.ts, p.ts), '%Y-%m-%d %H:%M:%S') AS ts, round(v.value, 4) AS view, round(p.value, 4) AS error FROM v FULL JOIN p ON p.ts = v.ts""")
def join_outer_concat(spark, sf):
    q = quarter(spark, sf)
    of = lambda s: q.filter(F.col("series_id") == s).select("ts", F.col("value").alias(s))
    return tidy(of("view").join(of("error"), "ts", "full"))


@query("""SELECT r_name, c_mktsegment, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def broadcast_lookup_joins(spark, sf):
    """Nation and region are fixed dimensions of 25 and 5 rows."""
    t = lambda n: table(spark, sf, n)
    places = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    o = t("orders").filter("o_orderstatus = 'F'").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(places), F.col("n_nationkey") == F.col("c_nationkey"))
    return tidy(o.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")), 0)


@query(f"""WITH {QUARTER}, prof AS (SELECT series_id, isodow(ts) - 1 AS dow, hour(ts) AS h, avg(value) AS mean FROM q GROUP BY ALL)
SELECT q.series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value - mean, 4) AS deviation FROM q JOIN prof ON prof.series_id = q.series_id AND dow = isodow(ts) - 1 AND h = hour(ts)""")
def composite_key_lookup(spark, sf):
    q = quarter(spark, sf).withColumns({"dow": F.weekday("ts"), "h": F.hour("ts")})
    prof = q.groupBy("series_id", "dow", "h").agg(F.avg("value").alias("mean"))
    return tidy(q.join(prof, ["series_id", "dow", "h"]).select("series_id", "ts", (F.col("value") - F.col("mean")).alias("deviation")))


@query("SELECT c_custkey::BIGINT AS c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = c.join(o.filter("o_totalprice > 450000"), "c_custkey", "left_anti").select("c_custkey")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select("c_custkey").distinct().withColumn("urgent", F.lit(True))
    return kept.join(urgent, "c_custkey", "left").withColumn("urgent", F.coalesce("urgent", F.lit(False)))


@query(f"WITH {DAILY} SELECT a.d::VARCHAR AS d, round(a.total, 2) AS total, round(b.total, 2) AS year_before FROM daily a JOIN daily b ON b.d = a.d - 364")
def shift_selfjoin_364(spark, sf):
    d = daily(spark, sf)
    before = d.select(F.date_add("d", 364).alias("d"), F.col("total").alias("year_before"))
    return tidy(d.select("d", "total").join(before, "d"), 2)


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts AS error_ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT p.event_id::BIGINT AS event_id, coalesce(e.error_id, -1)::BIGINT AS error_id FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND e.error_ts <= p.ts""")
def asof_shape(spark, sf):
    """As-of join: the last error of the user at or before each purchase."""
    e = table(spark, sf, "events")
    right = e.filter("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("error_id"))
    return G.asof(e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "error_id").select("event_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"))


@query(f"""WITH {DAILY}, e AS (SELECT b.d, b.total AS y, b.total - a.total AS e FROM daily a JOIN daily b ON a.d = b.d - 364)
SELECT month(d)::BIGINT AS month, count(*)::BIGINT AS n, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, round(avg(e), 2) AS bias, round(stddev_pop(e), 2) AS rmse_unbiased, round(100 * avg(abs(e / y)), 2) AS mape, round(1 - var_pop(e) / var_pop(y), 4) AS r2 FROM e GROUP BY 1""")
def score_metrics(spark, sf):
    d = daily(spark, sf)
    before = d.select(F.date_add("d", 364).alias("d"), F.col("total").alias("pred"))
    scored = G.scores(d.join(before, "d").withColumn("month", F.month("d")), "total", "pred", ["month"])
    return tidy(scored.withColumns({k: rounded(F.col(k), 2) for k in ("rmse", "mae", "bias", "rmse_unbiased", "mape")}))


@query(f"""WITH {DAILY}, h AS (SELECT unnest(generate_series(1, 14)) AS h), e AS (SELECT h, b.total - a.total AS e, b.total AS y FROM h, daily a JOIN daily b ON b.d = a.d + h::INT)
SELECT h::BIGINT AS h, count(*)::BIGINT AS n, round(sqrt(avg(e * e)), 2) AS rmse, round(100 * avg(abs(e / y)), 2) AS mape FROM e GROUP BY 1""")
def by_horizon(spark, sf):
    d = daily(spark, sf).select("d", "total")
    issued = d.select("d", F.col("total").alias("pred"), F.explode(F.sequence(F.lit(1), F.lit(14))).alias("h")).select(F.date_add("d", F.col("h")).alias("d"), "h", "pred")
    return tidy(G.scores(issued.join(d, "d"), "total", "pred", ["h"]).select("h", "n", "rmse", "mape"), 2)


@query(f"WITH {DAILY} SELECT year(d)::BIGINT AS year, month(d)::BIGINT AS month, round(avg(total), 2) AS mean, round(sum(total), 0) AS total, count(*)::BIGINT AS n, round(min(total), 2) AS least, round(max(total), 2) AS most, round(stddev_samp(total), 2) AS sd, round(var_pop(total) / 1e6, 0) AS var_pop, round(median(total), 2) AS median FROM daily GROUP BY 1, 2")
def monthly_statistics(spark, sf):
    d = daily(spark, sf).groupBy(F.year("d").alias("year"), F.month("d").alias("month"))
    v = F.avg("total").alias("mean"), rounded(F.sum("total"), 0).alias("total"), F.count("*").alias("n"), F.min("total").alias("least"), F.max("total").alias("most"), F.stddev_samp("total").alias("sd"), rounded(F.var_pop("total") / 1e6, 0).alias("var_pop"), F.median("total").alias("median")
    return tidy(d.agg(*v), 2)


@query("""SELECT c_mktsegment, round(sum(o_totalprice) FILTER (isodow(o_orderdate) = 1), 0) AS mon, round(sum(o_totalprice) FILTER (isodow(o_orderdate) = 3), 0) AS wed, round(sum(o_totalprice) FILTER (isodow(o_orderdate) = 7), 0) AS sun
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def pivot_dow(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return tidy(o.withColumn("dow", F.date_format("o_orderdate", "E")).groupBy("c_mktsegment").pivot("dow", ["Mon", "Wed", "Sun"]).agg(F.sum("o_totalprice")).withColumnsRenamed({"Mon": "mon", "Wed": "wed", "Sun": "sun"}), 0)


@query("""WITH b AS (SELECT unnest(generate_series(0, 4)) AS xb), c AS (SELECT unnest(generate_series(0, 5)) AS yb), v AS (SELECT floor(l_quantity / 11)::INT AS xb, floor(l_discount / 0.02 + 1e-9)::INT AS yb, l_extendedprice AS p FROM lineitem)
SELECT b.xb::BIGINT AS xb, c.yb::BIGINT AS yb, count(p)::BIGINT AS n, round(avg(p), 2) AS mean FROM b CROSS JOIN c LEFT JOIN v ON v.xb = b.xb AND v.yb = c.yb GROUP BY 1, 2""")
def binned_table_2d(spark, sf):
    """Means on a dense grid of 5 x 6 bins, empty ones included."""
    li = table(spark, sf, "lineitem").select(F.floor(F.col("l_quantity") / 11).cast("int").alias("xb"), F.floor(F.col("l_discount") / 0.02 + 1e-9).cast("int").alias("yb"), "l_extendedprice")
    found = li.groupBy("xb", "yb").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"))
    grid = spark.range(30).select((F.col("id") / 6).cast("int").alias("xb"), (F.col("id") % 6).cast("int").alias("yb"))
    return tidy(grid.join(found, ["xb", "yb"], "left").withColumn("n", F.coalesce("n", F.lit(0))), 2)


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 2) AS q{int(100 * q)}" for q in QUANTILES) + " FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, QUANTILES))).alias("q"))
    return tidy(li.select("l_returnflag", *(F.col("q")[i].alias(f"q{int(100 * q)}") for i, q in enumerate(QUANTILES))), 2)


CELLS = """c AS (SELECT least(hour(ts) // 3, 7) AS cloud_bin, least(floor(greatest(value, 0) / 25), 6)::INT AS elev_bin, value, user_id + 1.0 AS clear FROM events)"""


@query(f"WITH {CELLS} SELECT cloud_bin::BIGINT AS cloud_bin, elev_bin::BIGINT AS elev_bin, count(*)::BIGINT AS n, round(sum(value) / sum(clear), 4) AS kt, round(quantile_cont(value / clear, 0.25), 4) AS q25, round(quantile_cont(value / clear, 0.75), 4) AS q75 FROM c GROUP BY 1, 2")
def kt_cells(spark, sf):
    """Ratio of sums and quantiles of the ratio in calibration cells."""
    return tidy(G.ratio_cells(_cells(spark, sf), ["cloud_bin", "elev_bin"], "value", "clear", [0.25, 0.75]).select("cloud_bin", "elev_bin", "n", "kt", F.col("kt_q")[0].alias("q25"), F.col("kt_q")[1].alias("q75")))


def _cells(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.least((F.hour("ts") / 3).cast("int"), F.lit(7)).alias("cloud_bin"), F.least(F.floor(F.greatest("value", F.lit(0)) / 25), F.lit(6)).cast("int").alias("elev_bin"), "value", (F.col("user_id") + 1.0).alias("clear"))


@query(f"""WITH {CELLS}, g AS (SELECT cloud_bin, elev_bin, count(*) AS n, sum(value) / sum(clear) AS kt FROM c GROUP BY 1, 2),
grid AS (SELECT a AS cloud_bin, b AS elev_bin FROM (SELECT unnest(generate_series(0, 7)) AS a), (SELECT unnest(generate_series(0, 6)) AS b)),
d AS (SELECT grid.cloud_bin, grid.elev_bin, CASE WHEN n >= 200 THEN kt END AS kt FROM grid LEFT JOIN g ON g.cloud_bin = grid.cloud_bin AND g.elev_bin = grid.elev_bin),
w AS (SELECT *, last_value(kt IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN kt IS NOT NULL THEN cloud_bin END IGNORE NULLS) OVER b AS t0, first_value(kt IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN kt IS NOT NULL THEN cloud_bin END IGNORE NULLS) OVER a AS t1 FROM d
 WINDOW b AS (PARTITION BY elev_bin ORDER BY cloud_bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY elev_bin ORDER BY cloud_bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
alone AS (SELECT cloud_bin, sum(value) / sum(clear) AS kt FROM c GROUP BY 1)
SELECT w.cloud_bin::BIGINT AS cloud_bin, w.elev_bin::BIGINT AS elev_bin, round(coalesce(w.kt, v0 + (v1 - v0) * (w.cloud_bin - t0) / nullif(t1 - t0, 0), v0, v1, alone.kt), 4) AS kt FROM w LEFT JOIN alone ON alone.cloud_bin = w.cloud_bin""")
def cells_fill(spark, sf):
    """Sparse cells filled along the first bin, whole columns without data by that bin alone."""
    rows = _cells(spark, sf)
    return tidy(G.fill_cells(G.ratio_cells(rows, ["cloud_bin", "elev_bin"], "value", "clear", []), G.ratio_cells(rows, ["cloud_bin"], "value", "clear", []), 8, 7, 200).select("cloud_bin", "elev_bin", "kt"))


@query("""SELECT year(l_shipdate)::BIGINT AS year, count(*)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS slope_se FROM lineitem GROUP BY 1""")
def group_regression(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return tidy(G.regressions(li, "l_extendedprice", "l_quantity", ["year"]))


@query("""WITH d AS (SELECT l_shipdate::DATE AS d, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1)
SELECT round((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 4) AS by_row, round(corr(a, b), 4) AS by_day FROM d""")
def corr_daily(spark, sf):
    li = table(spark, sf, "lineitem")
    day = li.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b")).agg(F.corr("a", "b").alias("by_day"))
    return tidy(li.agg(F.corr("l_quantity", "l_extendedprice").alias("by_row")).join(day))  # one row each


@query("""WITH x AS (SELECT 1.0::DOUBLE AS x0, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y FROM lineitem)
SELECT """ + ", ".join(f"round(sum(x{i} * x{j}), 2) AS g{i}{j}" for i in range(4) for j in range(i, 4)) + ", " + ", ".join(f"round(sum(x{i} * y) / 1e3, 1) AS c{i}" for i in range(4)) + ", count(*)::BIGINT AS n FROM x")
def gram_matrix(spark, sf):
    g = G.gram_columns(table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)), ["one", "l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return tidy(g.withColumns({f"c{i}": rounded(F.col(f"c{i}") / 1e3, 1) for i in range(4)}), 2)


@query("""WITH s AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, sum(o_totalprice) AS total, sum(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate)))
SELECT coalesce(year, 0)::BIGINT AS year, coalesce(month, 0)::BIGINT AS month, round(total, 0) AS total, round(100 * urgent / total, 4) AS urgent_share FROM s""")
def rollup_shares(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice", "o_orderpriority")
    r = o.rollup("year", "month").agg(F.sum("o_totalprice").alias("total"), F.sum(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))).alias("urgent"))
    return tidy(r.select(F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("month", F.lit(0)).alias("month"), rounded(F.col("total"), 0).alias("total"), (100 * F.col("urgent") / F.col("total")).alias("urgent_share")))


@query(f"""WITH {DAILY}, e AS (SELECT b.d, abs(b.total - a.total) AS e FROM daily a JOIN daily b ON b.d = a.d + 364) SELECT d::VARCHAR AS d, round(e, 2) AS e FROM e ORDER BY e DESC, d LIMIT 8""")
def worst_days_topk(spark, sf):
    d = daily(spark, sf).select("d", "total")
    before = d.select(F.date_add("d", 364).alias("d"), F.col("total").alias("pred"))
    e = d.join(before, "d").select("d", F.abs(F.col("total") - F.col("pred")).alias("e"))
    return tidy(e.orderBy(F.desc("e"), "d").limit(8), 2)


@query(f"WITH {QUARTER} SELECT series_id, ts::DATE::VARCHAR AS d, strftime(arg_max(ts, (value, -epoch(ts))), '%Y-%m-%d %H:%M:%S') AS peak, strftime(arg_min(ts, (value, epoch(ts))), '%Y-%m-%d %H:%M:%S') AS low FROM q GROUP BY 1, ts::DATE")
def peak_times(spark, sf):
    q = quarter(spark, sf)
    return tidy(q.groupBy("series_id", F.to_date("ts").alias("d")).agg(F.max_by("ts", F.struct("value", -F.unix_timestamp("ts"))).alias("peak"), F.min_by("ts", F.struct("value", "ts")).alias("low")))


@query(f"""WITH {QUARTER}, days AS (SELECT series_id, ts::DATE AS d FROM q GROUP BY 1, 2 HAVING count(*) >= 40)
SELECT q.series_id, count(DISTINCT q.ts::DATE)::BIGINT AS n_days, count(*)::BIGINT AS n_rows, round(avg(value), 4) AS mean FROM q JOIN days ON days.series_id = q.series_id AND days.d = q.ts::DATE GROUP BY 1""")
def full_days(spark, sf):
    """Rows of days that have enough slots."""
    q = quarter(spark, sf).withColumn("d", F.to_date("ts"))
    days = q.groupBy("series_id", "d").agg(F.count("*").alias("n")).filter("n >= 40").select("series_id", "d")
    return tidy(q.join(days, ["series_id", "d"], "left_semi").groupBy("series_id").agg(F.count_distinct("d").alias("n_days"), F.count("*").alias("n_rows"), F.avg("value").alias("mean")))


@query("""WITH e AS (SELECT *, ts::DATE AS d FROM events), m AS (SELECT event_type, d, avg(CASE WHEN hour(ts) < 6 THEN value END) / avg(value) AS night, avg(CASE WHEN hour(ts) >= 18 THEN value END) / avg(value) AS evening FROM e GROUP BY 1, 2)
SELECT event_type, isodow(d)::BIGINT AS dow, round(avg(night), 4) AS night, round(avg(evening), 4) AS evening, count(DISTINCT d)::BIGINT AS n_days FROM m GROUP BY 1, 2""")
def relative_shares(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    share = lambda c: F.avg(F.when(c, F.col("value"))) / F.avg("value")
    m = e.groupBy("event_type", "d").agg(share(F.hour("ts") < 6).alias("night"), share(F.hour("ts") >= 18).alias("evening"))
    return tidy(m.groupBy("event_type", (F.weekday("d") + 1).alias("dow")).agg(F.avg("night").alias("night"), F.avg("evening").alias("evening"), F.count_distinct("d").alias("n_days")))


@query("""WITH s AS (SELECT event_type, hour(ts) AS h, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL), l AS (SELECT *, CASE WHEN d BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN 'before' WHEN d BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' THEN 'after' END AS side FROM s)
SELECT event_type, h::BIGINT AS h, round(avg(v) FILTER (side = 'after') - avg(v) FILTER (side = 'before'), 4) AS effect,
round(sqrt(var_samp(v) FILTER (side = 'after') / count(*) FILTER (side = 'after') + var_samp(v) FILTER (side = 'before') / count(*) FILTER (side = 'before')), 4) AS se FROM l WHERE side IS NOT NULL GROUP BY 1, 2""")
def switch_profile_difference(spark, sf):
    """Difference of the daily profile after and before a switch date, with its standard error."""
    s = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("h"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return tidy(G.profile_difference(s, "v", ["event_type", "h"], F.col("d").between("2024-01-08", "2024-01-14"), F.col("d").between("2024-01-15", "2024-01-21")))


@query("SELECT d::VARCHAR AS d FROM ((SELECT o_orderdate::DATE AS d FROM orders WHERE o_totalprice > 400000 UNION SELECT l_shipdate::DATE FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09) INTERSECT SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'O') EXCEPT (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority = '5-LOW')")
def set_ops(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    day = lambda df, c: df.select(F.to_date(c).alias("d"))
    both = day(o.filter("o_totalprice > 400000"), "o_orderdate").union(day(li.filter("l_quantity = 50 and l_discount > 0.09"), "l_shipdate")).distinct()
    return tidy(both.intersect(day(o.filter("o_orderstatus = 'O'"), "o_orderdate")).exceptAll(day(o.filter("o_orderpriority = '5-LOW'"), "o_orderdate").distinct()))


@query("SELECT o_custkey::BIGINT AS o_custkey, o_orderkey::BIGINT AS o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_keep_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return tidy(W.dedupe_last(o, ["o_custkey"], "at").drop("at"), 2)


@query("SELECT user_id::BIGINT AS user_id, event_id::BIGINT AS event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_keep_first(spark, sf):
    e = table(spark, sf, "events")
    return W.keep_first(e, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_id")


@query(f"""WITH {QUARTER} SELECT series_id, to_json({{'n': count(*), 'max': round(max(value), 1)}})::VARCHAR AS payload FROM q GROUP BY 1""")
def json_payload(spark, sf):
    q = quarter(spark, sf).groupBy("series_id").agg(F.to_json(F.struct(F.count("*").alias("n"), rounded(F.max("value"), 1).alias("max"))).alias("payload"))
    return q
