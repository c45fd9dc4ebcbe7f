"""Scalar functions: sun, responses, bases, numerics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import basis as B
from loadloom.functions import numeric as N
from loadloom.functions import physics as P
from loadloom.functions import solar as S
from loadloom.queries.base import QUARTER, query, quarter, table, tidy

LAT, LON = math.radians(C.LATITUDE), C.LONGITUDE


def orbit_sql(doy: str, hr: str) -> tuple[str, str]:
    g = f"(2 * pi() / 365 * ({doy} - 1 + ({hr} - 12) / 24))"
    eqt = f"(229.18 * (0.000075::DOUBLE + 0.001868::DOUBLE * cos({g}) - 0.032077::DOUBLE * sin({g}) - 0.014615::DOUBLE * cos(2 * {g}) - 0.040849::DOUBLE * sin(2 * {g})))"
    dec = f"(0.006918::DOUBLE - 0.399912::DOUBLE * cos({g}) + 0.070257::DOUBLE * sin({g}) - 0.006758::DOUBLE * cos(2 * {g}) + 0.000907::DOUBLE * sin(2 * {g}) - 0.002697::DOUBLE * cos(3 * {g}) + 0.00148::DOUBLE * sin(3 * {g}))"
    return eqt, dec


def zenith_sql(ts: str) -> str:
    hr = f"(hour({ts}) + minute({ts}) / 60.0::DOUBLE)"
    eqt, dec = orbit_sql(f"dayofyear({ts})", hr)
    return f"(sin({LAT!r}::DOUBLE) * sin({dec}) + cos({LAT!r}::DOUBLE) * cos({dec}) * cos(radians(({hr} * 60 + {eqt} + 4 * {LON}) / 4 - 180)))"


def elevation_sql(ts: str) -> str:
    return f"(90 - degrees(acos(greatest(least({zenith_sql(ts)}, 1.0), -1.0))))"


def dark_sql(ts: str) -> str:
    return f"(1 / (1 + exp(({elevation_sql(ts)} + 2.0) / 1.5)))"


SLOT = "t AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events)"


def slots(spark, sf):
    return quarter(spark, sf).select("ts").distinct()


@query(f"WITH {SLOT} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({elevation_sql('ts')}, 4) AS elevation, round(CASE WHEN {zenith_sql('ts')} > 0.01 THEN 1098.0 * {zenith_sql('ts')} * exp(-0.057 / {zenith_sql('ts')}) ELSE 0.0 END, 4) AS clear_sky FROM t")
def solar_elevation(spark, sf):
    return tidy(slots(spark, sf).select("ts", S.elevation(F.col("ts")).alias("elevation"), S.clear_sky(F.col("ts")).alias("clear_sky")))


def _times_sql() -> str:
    eqt, dec = orbit_sql("dayofyear(d)", "12.0")
    half = f"degrees(acos(cos(radians(90.833)) / (cos({LAT!r}::DOUBLE) * cos({dec})) - tan({LAT!r}::DOUBLE) * tan({dec})))"
    return f"WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d::VARCHAR AS date, round(720 - 4 * ({LON} + {half}) - {eqt}, 4) AS sunrise, round(720 - 4 * ({LON} - {half}) - {eqt}, 4) AS sunset FROM d"


@query(_times_sql())
def sunrise_and_sunset(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    rise, fall = S.sun_minutes(F.col("date"))
    return tidy(d.select("date", rise.alias("sunrise"), fall.alias("sunset")))


DARK3 = "(" + " + ".join(dark_sql(f"(ts + INTERVAL {s} SECOND)") for s in (150, 450, 750)) + ") / 3"


@query(f"WITH {QUARTER}, k AS (SELECT series_id, ts, value, {DARK3} AS dark FROM q) SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(dark, 4) AS dark, round((1 - dark) * exp(-greatest(value, 0.0) / 40.0), 4) AS gloom FROM k")
def darkness_and_gloom(spark, sf):
    q = quarter(spark, sf).withColumn("dark", S.darkness_of_slot(F.col("ts")))
    return tidy(q.select("series_id", "ts", "dark", S.gloom(F.col("dark"), F.col("value")).alias("gloom")))


@query("""SELECT event_id::BIGINT AS event_id, round(CASE WHEN (value - 50) / 2.0 > 30 THEN value - 50 ELSE 2.0 * ln(1 + exp(least((value - 50) / 2.0, 30.0))) END, 4) AS softplus,
round(greatest(1 + 0.02::DOUBLE * value, 0.2), 4) AS cop, round(greatest(1 - 0.03::DOUBLE * (value - 25), 0.3), 4) AS eer, round(1 - 0.004::DOUBLE * (value - 25), 4) AS pv,
round(value + 0.01::DOUBLE * 300 - 0.005::DOUBLE * 4 * greatest(20 - value, 0.0), 4) AS felt FROM events""")
def response_functions(spark, sf):
    v = F.col("value")
    return tidy(
        table(spark, sf, "events").select(
            "event_id", P.softplus(v - 50, 2.0).alias("softplus"), P.cop(v, 0.02).alias("cop"), P.eer(v, 0.03).alias("eer"), P.pv_efficiency(v, 0.004).alias("pv"),
            P.felt_temperature(v, F.lit(300.0), F.lit(4.0), 0.01, 0.005).alias("felt"),
        )
    )


TOD = "t AS (SELECT DISTINCT (hour(ts) + minute(time_bucket(INTERVAL 15 MINUTE, ts)) / 60.0)::DOUBLE AS tod FROM events)"


def tods(spark, sf):
    ts = quarter(spark, sf).select("ts")
    return ts.select((F.hour("ts") + F.minute("ts") / 60.0).alias("tod")).distinct()


FOURIER = [f"round({fn}(tod * 2 * pi() * {j} / 24), 4) + 0.0 AS {fn}{j}" for fn in ("cos", "sin") for j in (1, 2, 3, 4)]


@query(f"WITH {TOD} SELECT round(tod, 4) AS tod, {', '.join(FOURIER)} FROM t")
def fourier_features(spark, sf):
    f = tods(spark, sf).withColumn("f", B.fourier(F.col("tod"), 4))
    names = [f"{fn}{j}" for fn in ("cos", "sin") for j in (1, 2, 3, 4)]
    return tidy(f.select("tod", *(F.col("f")[k].alias(n) for k, n in enumerate(names))))


@query("""WITH t AS (SELECT DISTINCT datediff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS x FROM orders)
SELECT x, array_to_string(list_transform([90 * i FOR i IN generate_series(1, 25)], lambda j: printf('%.3f', greatest(least((least(x, 2400.0) - j) / 90.0, 1.0), 0.0))), ',') AS ramps FROM t""")
def ramp_basis(spark, sf):
    t = table(spark, sf, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("double").alias("x")).distinct()
    shown = F.array_join(F.transform(F.slice(B.ramps(F.col("x"), 2400.0), 2, 100), lambda r: F.format_string("%.3f", r)), ",")
    return t.select("x", shown.alias("ramps"))


@query()
def bspline_basis(spark, sf):
    """Night, lighting and gloom splines of the distinct times of day; sums over whole bases are 1 (see tests)."""
    t = tods(spark, sf)
    return tidy(t.select("tod", *(F.aggregate(b, F.lit(0.0), lambda a, x: a + x).alias(n) for n, b in (("night", B.night_basis(F.col("tod"))), ("light", B.light_basis(F.col("tod"))), ("gloom", B.gloom_basis(F.col("tod")))))))


@query(f"WITH {TOD} SELECT round(tod, 4) AS tod, round(1 * cos(tod * 2 * pi() / 24), 4) + 0.0 AS p0, round(1 * sin(tod * 2 * pi() / 24), 4) + 0.0 AS p1, round(tod / 24 * cos(tod * 2 * pi() / 24), 4) + 0.0 AS p2, round(tod / 24 * sin(tod * 2 * pi() / 24), 4) + 0.0 AS p3 FROM t")
def row_products(spark, sf):
    p = tods(spark, sf).withColumn("p", B.row_product(F.array(F.lit(1.0), F.col("tod") / 24), B.fourier(F.col("tod"), 1)))
    return tidy(p.select("tod", *(F.col("p")[k].alias(f"p{k}") for k in range(4))))


@query("""SELECT event_id::BIGINT AS event_id, CASE WHEN value = 0 THEN 0.0 ELSE round(value * pow(10.0, 3 - ceil(log10(abs(value))))) / pow(10.0, 3 - ceil(log10(abs(value)))) END AS significant FROM events WHERE abs(value) > 1e-3""")
def significant_digits(spark, sf):
    e = table(spark, sf, "events").filter("abs(value) > 1e-3")
    return e.select("event_id", N.significant(F.col("value"), 3).alias("significant"))


@query("""SELECT len(list_filter([0.1, 0.2, 0.3, 0.45, 0.6, 0.75], lambda e: e::DOUBLE <= (value / 200)::DOUBLE))::BIGINT AS elevation_bin, least(floor(greatest(value, 0) / 10), 9)::BIGINT AS cloud_bin,
count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def digitized_bins(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    found = e.select(N.bin_left(v / 200, C.ELEVATION_EDGES).alias("elevation_bin"), F.least(F.floor(F.greatest(v, F.lit(0)) / 10), F.lit(9)).alias("cloud_bin"))
    return tidy(found.groupBy("elevation_bin", "cloud_bin").agg(F.count("*").alias("n")))


@query("""WITH b AS (SELECT CASE WHEN value > 0 AND value <= 20 THEN 0 WHEN value > 20 AND value <= 50 THEN 1 WHEN value > 50 AND value <= 100 THEN 2 END AS bin, value FROM events)
SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(value), 4) AS value FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def cut_bins(spark, sf):
    e = table(spark, sf, "events").withColumn("bin", N.bin_right(F.col("value"), (0.0, 20.0, 50.0, 100.0))).filter("bin is not null")
    return tidy(e.groupBy("bin").agg(F.count("*").alias("n"), F.avg("value").alias("value")))


@query("""WITH p AS (SELECT event_id, least(greatest(value, 10.0), 90.0) AS x, least(greatest(user_id * 1.0, 10.0), 130.0) AS y FROM events),
k AS (SELECT *, CASE WHEN x >= 50 THEN 1 ELSE 0 END AS i, CASE WHEN y >= 70 THEN 1 ELSE 0 END AS j FROM p), w AS (SELECT *, (x - [10.0, 50.0][i + 1]) / 40 AS p, (y - [10.0, 70.0][j + 1]) / 60 AS q FROM k)
SELECT event_id::BIGINT AS event_id, round(((1 - p) * ((1 - q) * (i * 3 + j * j) + q * (i * 3 + (j + 1) * (j + 1))) + p * ((1 - q) * ((i + 1) * 3 + j * j) + q * ((i + 1) * 3 + (j + 1) * (j + 1))))::DOUBLE, 4) AS z FROM w""")
def bilinear_lookup(spark, sf):
    cells = F.array(*(F.array(*(F.lit(float(3 * i + j * j)) for j in range(3))) for i in range(3)))
    z = N.bilinear(cells, F.col("value"), F.col("user_id").cast("double"), [10.0, 50.0, 90.0], [10.0, 70.0, 130.0])
    return tidy(table(spark, sf, "events").select("event_id", z.alias("z")))


@query("""SELECT c_custkey::BIGINT AS c_custkey, substring(c_name, 1, 8) AS head, regexp_extract(c_name, '([0-9]+)', 1) AS digits, starts_with(c_mktsegment, 'B') AS is_b, replace(printf('%.2f', c_acctbal), '.', ',') AS decimal_comma FROM customer""")
def string_functions(spark, sf):
    c = table(spark, sf, "customer")
    comma = F.regexp_replace(F.format_string("%.2f", "c_acctbal"), r"\.", ",")
    return c.select("c_custkey", F.substring("c_name", 1, 8).alias("head"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"), F.col("c_mktsegment").startswith("B").alias("is_b"), comma.alias("decimal_comma"))
