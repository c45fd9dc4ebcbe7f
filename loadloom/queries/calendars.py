"""The date dimension and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators import calendar as K
from loadloom.operators.timeaxis import on_axis, fill
from loadloom.queries.base import AXIS, daily, quarter, query, table, tidy

YEARS = "y AS (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) - 1 FROM orders), (SELECT max(year(o_orderdate)) + 1 FROM orders)))::INT AS y)"
EASTER = YEARS + """, e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), e2 AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM e2), e4 AS (SELECT *, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS t FROM e3),
easter AS (SELECT y, make_date(y, (t // 31)::INT, (t % 31 + 1)::INT) AS easter FROM e4)"""
FIXED = ", ".join(f"('{d}')" for d in C.FIXED_HOLIDAYS)
HOLIDAYS = EASTER + f""", holidays AS (SELECT DISTINCT d FROM (SELECT (y || '-' || md)::DATE AS d FROM y, (VALUES {FIXED}) AS t(md)
UNION ALL SELECT (easter - INTERVAL 2 DAY)::DATE FROM easter UNION ALL SELECT (easter + INTERVAL 1 DAY)::DATE FROM easter))"""
DAYS = HOLIDAYS + """, d0 AS (SELECT unnest(generate_series((SELECT date_trunc('year', min(o_orderdate)) - INTERVAL 61 DAY FROM orders)::TIMESTAMP, (SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 400 DAY FROM orders)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d),
d1 AS (SELECT d0.d, h.d IS NOT NULL AS hol, h.d IS NOT NULL OR isodow(d0.d) >= 6 AS off FROM d0 LEFT JOIN holidays h ON h.d = d0.d),
d2 AS (SELECT *, sum(off::INT) OVER (ORDER BY d) AS run, lag(hol) OVER (ORDER BY d) AS hb, lead(hol) OVER (ORDER BY d) AS ha, lag(off) OVER (ORDER BY d) AS ob, lead(off) OVER (ORDER BY d) AS oa FROM d1),
d3 AS (SELECT *, sum((NOT off)::INT) OVER (PARTITION BY run) AS len, max((NOT off AND (hb OR ha))::INT) OVER (PARTITION BY run) AS near FROM d2),
dim AS (SELECT d, off, hol, ob, oa, CASE WHEN NOT off AND len <= 2 AND near = 1 THEN len ELSE 0 END AS bridge_len, strftime(d, '%m-%d') AS md FROM d3)"""
DATES = "od AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)"


def dimension(spark, stamps):
    """The date dimension over all years that a column of stamps touches."""
    years = stamps.select(F.year(F.min(stamps.columns[0])), F.year(F.max(stamps.columns[0]))).first()
    return K.date_dimension(spark, f"{years[0] - 1}-12-01", f"{years[1] + 1}-01-31")


def order_years(spark, sf):
    """From the year before the first order to the one after the last."""
    first, last = table(spark, sf, "orders").select(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    return first - 1, last + 1


def order_days(spark, sf):
    return dimension(spark, table(spark, sf, "orders").select("o_orderdate"))


def of_orders(spark, sf):
    """The dimension at the orders' dates."""
    dates = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return dates.join(F.broadcast(order_days(spark, sf)), "date")


@query(f"WITH {EASTER} SELECT y::BIGINT AS year, easter::VARCHAR AS easter FROM easter")
def easter_sundays(spark, sf):
    return tidy(K.years(spark, *order_years(spark, sf)).select("year", K.easter(F.col("year")).alias("easter")))


@query(f"WITH {HOLIDAYS} SELECT d::VARCHAR AS date FROM holidays")
def public_holidays(spark, sf):
    return tidy(K.holidays(spark, *order_years(spark, sf)))


@query(f"""WITH {EASTER} SELECT DISTINCT date FROM (SELECT ((y || '-' || md)::DATE)::VARCHAR AS date FROM y, (VALUES {", ".join(f"('{d}')" for d in C.SHOPS_CLOSED)}) AS t(md)
UNION ALL SELECT ((easter + INTERVAL 1 DAY)::DATE)::VARCHAR FROM easter)""")
def shop_closing_days(spark, sf):
    return tidy(K.shops_closed(spark, *order_years(spark, sf)))


@query(f"WITH {DAYS}, {DATES} SELECT dim.d::VARCHAR AS date, bridge_len::BIGINT AS bridge_len FROM dim JOIN od ON od.d = dim.d WHERE bridge_len > 0")
def bridge_islands(spark, sf):
    return tidy(of_orders(spark, sf).filter("bridge").select("date", "bridge_len"))


@query(f"""WITH {DAYS}, {DATES} SELECT dim.d::VARCHAR AS date, (CASE WHEN NOT off THEN CASE WHEN oa THEN 1 ELSE 0 END ELSE CASE WHEN oa THEN 2 ELSE 3 END END)::BIGINT AS daytype, ob AS after_off
FROM dim JOIN od ON od.d = dim.d""")
def day_roles(spark, sf):
    return tidy(of_orders(spark, sf).select("date", "daytype", "after_off"))


@query(f"""WITH {DAYS}, {DATES} SELECT dim.d::VARCHAR AS date, array_to_string(list_filter([CASE WHEN md = '12-24' THEN 'stedry_den' END, CASE WHEN md = '12-25' THEN 'bozi_hod' END, CASE WHEN md = '12-26' THEN 'sv_stepan' END,
CASE WHEN md BETWEEN '12-27' AND '12-31' AND NOT off THEN 'mezi_svatky_prac' END, CASE WHEN md BETWEEN '12-27' AND '12-31' AND off THEN 'mezi_svatky_vikend' END, CASE WHEN md = '12-31' THEN 'silvestr' END,
CASE WHEN md = '01-01' THEN 'novy_rok' END, CASE WHEN bridge_len > 0 AND (md BETWEEN '12-20' AND '12-23' OR md BETWEEN '01-02' AND '01-06') THEN 'most_vanoce' END], lambda x: x IS NOT NULL), ',') AS periods
FROM dim JOIN od ON od.d = dim.d WHERE md >= '12-20' OR md <= '01-06'""")
def special_periods(spark, sf):
    near = F.date_format("date", "MM-dd")
    return tidy(of_orders(spark, sf).filter((near >= "12-20") | (near <= "01-06")).select("date", F.array_join("periods", ",").alias("periods")))


@query(f"""WITH {DATES}, p AS (SELECT d, datediff('day', DATE '2001-06-10', make_date(2001, month(d)::INT, CASE WHEN month(d) = 2 THEN least(day(d), 28) ELSE day(d) END::INT)) AS k FROM od)
SELECT d::VARCHAR AS date, CASE WHEN k BETWEEN 0 AND 102 THEN k::DOUBLE ELSE -1.0 END AS summer_day, strftime(d, '%m-%d') BETWEEN '07-01' AND '08-31' AS summer_holiday FROM p""")
def summer_position(spark, sf):
    return tidy(of_orders(spark, sf).select("date", "summer_day", "summer_holiday"))


@query(f"""WITH {DAYS}, s AS (SELECT d, hol OR bridge_len > 0 OR md >= '12-21' OR md <= '01-03' AS irregular, hol OR bridge_len > 0 OR md >= '12-22' OR md <= '01-03' AS near FROM dim),
w AS (SELECT d, irregular, max(near::INT) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS context FROM s), {DATES}
SELECT w.d::VARCHAR AS date, irregular, context FROM w JOIN od ON od.d = w.d""")
def irregular_days(spark, sf):
    return tidy(of_orders(spark, sf).select("date", "irregular", "context"))


@query(f"""WITH {YEARS} SELECT y::BIGINT AS year, (make_date(y, 4, 1) - ((isodow(make_date(y, 3, 31)) % 7) + 1)::INT)::VARCHAR AS spring, (make_date(y, 11, 1) - ((isodow(make_date(y, 10, 31)) % 7) + 1)::INT)::VARCHAR AS autumn FROM y""")
def clock_changes(spark, sf):
    return tidy(K.clock_changes(spark, *order_years(spark, sf)))


@query("""WITH g AS (SELECT o_orderdate::DATE AS d, o_totalprice AS p, strftime(o_orderdate, '%m-%d') AS md FROM orders), l AS (SELECT *,
CASE WHEN md = '12-24' THEN 'eve' WHEN md = '12-25' THEN 'day_1' WHEN md = '12-26' THEN 'day_2' WHEN md = '12-31' THEN 'new_years_eve' WHEN md = '01-01' THEN 'new_year'
WHEN md BETWEEN '12-20' AND '12-23' THEN 'before' WHEN md BETWEEN '12-27' AND '12-30' THEN 'between' WHEN md BETWEEN '01-02' AND '01-06' THEN 'after' END AS grp,
CASE WHEN month(d) <= 6 THEN year(d) - 1 ELSE year(d) END AS season FROM g)
SELECT grp AS christmas, season::BIGINT AS season, count(*)::BIGINT AS n, round(avg(p), 2) AS mean_price FROM l WHERE grp IS NOT NULL GROUP BY 1, 2""")
def christmas_by_season(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_totalprice")
    o = o.select(K.christmas_group(F.col("d")).alias("christmas"), K.season_year(F.col("d")).alias("season"), "o_totalprice").filter("christmas is not null")
    return tidy(o.groupBy("christmas", "season").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price")), 2)


PROFILE_DAYS = DAYS.replace("o_orderdate", "ts").replace("FROM orders", "FROM events")


@query(f"""WITH {PROFILE_DAYS}, {AXIS}, l AS (SELECT *, timezone('Europe/Prague', timezone('UTC', ts)) AS lt FROM lim)
SELECT series_id, (CASE WHEN NOT off THEN CASE WHEN oa THEN 1 ELSE 0 END ELSE CASE WHEN oa THEN 2 ELSE 3 END END)::BIGINT AS daytype, round(hour(lt) + minute(lt) / 60.0, 4) AS tod, round(avg(value), 4) AS value, count(value)::BIGINT AS n
FROM l JOIN dim ON dim.d = lt::DATE GROUP BY ALL""")
def day_role_profile(spark, sf):
    """Flagship: mean profile of the day for each day role, over a gap-filled quarter-hourly axis in local time."""
    series = fill(on_axis(quarter(spark, sf)), "value")
    rows = K.with_calendar(series, dimension(spark, table(spark, sf, "events").select("ts")))
    return tidy(rows.groupBy("series_id", "daytype", "tod").agg(F.avg("value").alias("value"), F.count("value").alias("n")))


@query(f"""WITH {DAYS}, daily AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT daily.d::VARCHAR AS date, round(total, 2) AS total FROM daily JOIN dim ON dim.d = daily.d WHERE NOT (hol OR bridge_len > 0 OR md >= '12-21' OR md <= '01-03')""")
def regular_days_only(spark, sf):
    """Anti join against the irregular days."""
    d = daily(spark, sf).withColumnRenamed("d", "date")
    odd = order_days(spark, sf).filter("irregular").select("date")
    return tidy(d.join(F.broadcast(odd), "date", "left_anti").select("date", "total"), 2)


@query(f"""WITH {DAYS}, t AS (SELECT o_orderdate::DATE AS d, o_totalprice AS p FROM orders), cut AS (SELECT DATE '2000-06-30' AS c)
SELECT count(*)::BIGINT AS n_rows, round(sum(p), 2) AS total FROM t JOIN (SELECT d, max((hol OR bridge_len > 0 OR md >= '12-22' OR md <= '01-03')::INT) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS context FROM dim) k ON k.d = t.d, cut
WHERE t.d < c AND (t.d >= c - 365 OR context)""")
def training_rows(spark, sf):
    """Rows before a cutoff: the last year, and holidays with their neighbourhood from all history."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    rows = o.join(F.broadcast(order_days(spark, sf).select("date", "context")), "date")
    cut = F.lit("2000-06-30").cast("date")
    rows = rows.filter((F.col("date") < cut) & ((F.col("date") >= F.date_sub(cut, 365)) | F.col("context")))
    return tidy(rows.agg(F.count("*").alias("n_rows"), F.sum("o_totalprice").alias("total")), 2)
