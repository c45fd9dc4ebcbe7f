"""Helpers of the query modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL twins.
QUARTER = "q AS (SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"
AXIS = QUARTER + """, ends AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM q GROUP BY 1),
ax AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS ts FROM ends),
f AS (SELECT ax.series_id, ax.ts, q.value FROM ax LEFT JOIN q ON q.series_id = ax.series_id AND q.ts = ax.ts),
around AS (SELECT *,
  last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS t0,
  first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER a AS t1
  FROM f WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lim AS (SELECT series_id, ts, value AS raw, coalesce(value, CASE WHEN (epoch(ts) - t0) / 900 <= 4 THEN coalesce(v0 + (v1 - v0) * (epoch(ts) - t0) / nullif(t1 - t0, 0), v0) END) AS value FROM around),
bothways AS (SELECT series_id, ts, coalesce(value, v0 + (v1 - v0) * (epoch(ts) - t0) / nullif(t1 - t0, 0), v0, v1) AS value FROM around)"""
DAILY = "daily AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1)"
#: Ridge coefficients c1 to c3 of ``error`` on x1 to x3 of the table ft, from the days up to two before each, by Cramer's rule.
SOLVED = """mo AS (SELECT d, sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x1*x3) AS c, sum(x2*x2) AS e, sum(x2*x3) AS f, sum(x3*x3) AS i, sum(x1*error) AS p, sum(x2*error) AS q, sum(x3*error) AS r, 1 AS k FROM ft WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND error IS NOT NULL GROUP BY 1),
al AS (SELECT DISTINCT d FROM ft), rn AS (SELECT al.d, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(e) AS e, sum(f) AS f, sum(i) AS i, sum(p) AS p, sum(q) AS q, sum(r) AS r, sum(k) AS k FROM al JOIN mo ON mo.d <= al.d - 2 GROUP BY 1),
rg AS (SELECT d, a + z AS a, b, c, e + z AS e, f, i + z AS i, p, q, r FROM (SELECT *, 0.001 * (a + e + i) / 3 AS z FROM rn WHERE k >= {least})),
co AS (SELECT d, (p*(e*i - f*f) - b*(q*i - f*r) + c*(q*f - e*r)) / t AS c1, (a*(q*i - f*r) - p*(b*i - f*c) + c*(b*r - q*c)) / t AS c2, (a*(e*r - q*f) - b*(b*r - q*c) + p*(b*f - e*c)) / t AS c3 FROM (SELECT *, a*(e*i - f*f) - b*(b*i - f*c) + c*(b*f - e*c) AS t FROM rg))"""
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


#: Digits beyond those compared: sums of other orders differ in the last bits, and rounding to so many digits first makes a tie a tie.
SPARE = 5


def settled(sql: str) -> str:
    """``round(x, n)`` of a SQL text with x as a decimal of n + 5 digits first, so that ties round alike in all engines."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, i, comma = 1, m.end(), None
        while depth:
            c = sql[i]
            depth += c in "([{"
            depth -= c in ")]}"
            if c == "," and depth == 1:
                comma = i
            i += 1
        inner = settled(sql[m.end() : comma if comma is not None else i - 1])
        if comma is None:
            out += [sql[at : m.end()], inner, ")"]
        else:
            places = int(sql[comma + 1 : i - 1])
            out += [sql[at : m.start()], f"round(TRY_CAST(({inner}) AS DECIMAL(38, {places + SPARE})), {places})::DOUBLE"]
        at = i
    return "".join([*out, sql[at:]])


def rounded(c: Column, places: int) -> Column:
    """The same in Spark; negative zero becomes zero."""
    return F.round(F.round(c.cast("double"), places + SPARE), places) + F.lit(0.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = settled(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hourly means of the events' values, one series for each type."""
    from loadloom.operators.timeaxis import floor_to

    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return events.groupBy("series_id", floor_to(F.col("ts"), 15).alias("slot")).agg(F.avg("value").alias("value")).withColumnRenamed("slot", "ts")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter-hourly series without gaps."""
    from loadloom.operators.timeaxis import fill, on_axis

    return fill(on_axis(quarter(spark, sf_dir)), "value", limit=None, both=True)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and number of orders a day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


def tidy(df: DataFrame, places: int = 4) -> DataFrame:
    """Longs, rounded doubles, and instants and dates as strings, so that engines compare alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rounded(c, places)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
