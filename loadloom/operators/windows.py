"""Sequence operators: recursive filters, lags, rolling means, carries, hysteresis, circular smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom.operators.timeaxis import SERIES


#: Chunks whose maps one array holds; the maps of such groups are composed in turn.
GROUP = 64
#: A running sum of weights up to e to this power keeps its precision.
LARGEST_EXPONENT = 300


def ema(df: DataFrame, value: str, alpha: float | Column, out: str, chunk: Column | None = None) -> DataFrame:
    """y[t] = (1 - alpha) y[t-1] + alpha x[t], seeded with the first value, exactly and without a task for a whole series; ``alpha`` may be
    a column that is constant within a series."""
    alpha = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return _filtered(df, [(F.col(value), 1 - alpha, out)], chunk)


def ema_many(df: DataFrame, filters: list[tuple[Column, float | Column, str]], step_hours: float, chunk: Column | None = None) -> DataFrame:
    """Several exponential filters in one pass: (value, time constant in hours, name). See ``ema``."""
    decay = lambda tau: F.exp(-step_hours / (F.lit(float(tau)) if isinstance(tau, (int, float)) else tau))
    return _filtered(df, [(x, decay(tau), name) for x, tau, name in filters], chunk)


def _filtered(df: DataFrame, filters: list[tuple[Column, Column, str]], chunk: Column | None) -> DataFrame:
    """y[t] = d y[t-1] + (1 - d) x[t] for each (x, d, name).

    A step is an affine map of y, and maps compose. Within a chunk (a day, or part of one where weights would grow too large) a running sum
    of weighted values gives the filter from zero. Each chunk is one map; the maps before it are composed in groups, and what enters the
    chunk is added to its rows with its decay.
    """
    n, day = len(filters), F.to_date("ts") if chunk is None else chunk
    rows = df.withColumns({f"_x{i}": x.cast("double") for i, (x, _, _) in enumerate(filters)} | {f"_d{i}": d for i, (_, d, _) in enumerate(filters)} | {"_day": day})
    rows_of = lambda d: F.when(d <= 0, 1.0).otherwise(F.coalesce(F.try_divide(F.lit(float(LARGEST_EXPONENT)), -F.ln(d)), F.lit(1e9)))
    most = F.least(*(rows_of(F.col(f"_d{i}")) for i in range(n)), F.lit(1e9))
    longest = F.greatest(F.floor(most), F.lit(1))
    rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(SERIES, "_day").orderBy("ts")) - 1)
    rows = rows.withColumn("_sub", F.floor(F.col("_pos") / longest)).withColumn("_i", F.col("_pos") - F.col("_sub") * longest)
    key = [SERIES, "_day", "_sub"]
    upto = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    alone = lambda i: (1 - F.col(f"_d{i}")) * F.pow(f"_d{i}", "_i") * F.sum(F.col(f"_x{i}") * F.pow(F.col(f"_d{i}"), -F.col("_i"))).over(upto)
    rows = rows.withColumns({f"_q{i}": alone(i) for i in range(n)})

    array = lambda p: F.array(*(F.col(f"{p}{i}") for i in range(n)))
    last = F.max_by(F.struct(array("_q").alias("q"), array("_d").alias("d")), "ts")
    maps = rows.groupBy(*key).agg(F.count("*").alias("k"), last.alias("_l"), F.min_by(array("_x"), "ts").alias("first"))
    order = Window.partitionBy(SERIES).orderBy("_day", "_sub")
    maps = maps.select(*key, "k", "_l.q", F.col("_l.d").alias("_d"), F.first("first").over(order).alias("_seed"), (F.row_number().over(order) - 1).alias("_c"))
    maps = maps.withColumn("_g", F.floor(F.col("_c") / GROUP))
    pairs = lambda y, q: F.zip_with(y, q, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    through = lambda y, m: F.zip_with(pairs(y, m["q"]), F.col("_d"), lambda z, d: F.pow(d, m["k"]) * z["a"] + z["b"])
    whole = F.sort_array(F.collect_list(F.struct("_c", "k", "q")))
    groups = maps.groupBy(SERIES, "_g").agg(whole.alias("m"), F.first("_d").alias("_d"), F.first("_seed").alias("_seed"))
    groups = groups.select(SERIES, "_g", "_d", "_seed", F.aggregate("m", F.lit(0).cast("long"), lambda s, m: s + m["k"]).alias("k"), F.aggregate("m", F.array_repeat(F.lit(0.0), n), through).alias("q"))
    earlier = Window.partitionBy(SERIES).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.collect_list(F.struct("k", "q")).over(earlier)).select(SERIES, "_g", F.aggregate("_before", F.col("_seed"), through).alias("_enters"))
    inside = Window.partitionBy(SERIES, "_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    entering = maps.withColumn("_before", F.collect_list(F.struct("k", "q")).over(inside)).join(groups, [SERIES, "_g"])
    entering = entering.select(*key, F.aggregate("_before", F.col("_enters"), through).alias("_y"))
    both = rows.join(entering, key)
    return both.select(*df.columns, *((F.col(f"_q{i}") + F.pow(F.col(f"_d{i}"), F.col("_i") + 1) * F.col("_y")[i]).alias(f[2]) for i, f in enumerate(filters)))


def lags(df: DataFrame, value: str, offsets: list[int], by: list[str] = (SERIES,), order: str = "ts") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in offsets})


def rolling(value: str, before: int, after: int, least: int = 1, by: list[str] = (SERIES,), order: str = "ts") -> Column:
    """Mean over a frame of rows; null where fewer than ``least`` values are known."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def rolling_seconds(value: str, before: int, after: int, by: list[str] = (SERIES,), order: str = "ts") -> Column:
    w = Window.partitionBy(*by).orderBy(F.unix_timestamp(order)).rangeBetween(-before, after)
    return F.avg(value).over(w)


def forward_fill(value: Column, by: list[str] = (SERIES,), order: str = "ts") -> Column:
    return F.last(value, True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def hysteresis(on: Column, off: Column, by: list[str] = (SERIES,), order: str = "ts") -> Column:
    """Two-state switch: the state changes at events only, so it is the last event; 0 before any."""
    return F.coalesce(forward_fill(F.when(off, 0).when(on, 1), by, order), F.lit(0))


def circular_mean(df: DataFrame, value: str, key: str, period: int, reach: int, by: list[str], out: str) -> DataFrame:
    """Centred mean over a cyclic key from 1 to ``period``: each value is laid on the keys it reaches, then averaged; no sort."""
    laid = df.select(*by, key, value, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_k"))
    spread = laid.select(*by, value, (F.pmod(F.col(key) - 1 + F.col("_k"), F.lit(period)) + 1).alias(key))
    return spread.groupBy(*by, key).agg(F.avg(value).alias(out))


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key; partial maxima are merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def same_slot_history(df: DataFrame, value: str, days: int, step: int = 900, slots: int = 4, out: str = "history") -> DataFrame:
    """Mean of ``value`` over the hour that ends at each slot, on the previous ``days`` days: offsets are joined as equalities."""
    offsets = F.explode(F.array(*(F.lit(86400 * (d + 1) + step * s) for d in range(days) for s in range(slots))))
    laid = df.select(SERIES, F.col(value).alias("_v"), "ts", offsets.alias("_o")).select(SERIES, (F.timestamp_seconds(F.unix_timestamp("ts") + F.col("_o"))).alias("ts"), "_v")
    means = laid.groupBy(SERIES, "ts").agg(F.avg("_v").alias(out))
    return df.join(means, [SERIES, "ts"], "left")


def running_moments(df: DataFrame, x: list[str], y: str, by: list[str], order: str, delay: int) -> DataFrame:
    """Running sums of products up to ``delay`` rows back: what an online regression knows at each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -delay)
    pairs = {f"g_{i}_{j}": F.sum(F.col(a) * F.col(b)).over(w) for i, a in enumerate(x) for j, b in enumerate(x) if j >= i}
    return df.withColumns(pairs | {f"c_{i}": F.sum(F.col(a) * F.col(y)).over(w) for i, a in enumerate(x)} | {"known": F.count(y).over(w)})
