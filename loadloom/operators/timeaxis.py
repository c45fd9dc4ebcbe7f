"""Regular time axes, resampling, gap filling and local time.

Frames hold one row for each ``series_id`` and instant ``ts`` (TIMESTAMP, session zone UTC). Windows run over one series, whose length
is bounded by its time span; series are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom import config as C

SERIES = "series_id"
STEP = f"interval {C.STEP_MINUTES} minutes"


def floor_to(ts: Column, minutes: int) -> Column:
    """The start of the interval of ``minutes`` that holds the instant."""
    seconds = F.unix_timestamp(ts)
    return F.timestamp_seconds(seconds - seconds % (60 * minutes))


def resample(df: DataFrame, minutes: int, means: list[str], firsts: list[str] = (), by: list[str] | None = None) -> DataFrame:
    """Means of measures and the first value of calendar columns in each interval that has rows."""
    by = [SERIES] if by is None else by
    ts = floor_to(F.col("ts"), minutes)
    found = df.groupBy(*by, ts.alias("slot")).agg(*(F.avg(c).alias(c) for c in means), *(F.min_by(c, "ts").alias(c) for c in firsts))
    return found.withColumnRenamed("slot", "ts")


def axis(df: DataFrame, minutes: int = C.STEP_MINUTES, by: list[str] | None = None) -> DataFrame:
    """Every interval from a series' first to its last."""
    by = [SERIES] if by is None else by
    ends = df.groupBy(*by).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return ends.select(*by, F.explode(F.sequence("first", "last", F.expr(f"interval {minutes} minutes"))).alias("ts"))


def on_axis(df: DataFrame, minutes: int = C.STEP_MINUTES, by: list[str] | None = None) -> DataFrame:
    """The frame with a row for every interval; measures are null where there was none."""
    by = [SERIES] if by is None else by
    return axis(df, minutes, by).join(df, [*by, "ts"], "left")


def _around(value: str, by: list[str], order: str) -> tuple[Column, Column, Column, Column]:
    back = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    return F.last(value, True).over(back), F.last(at, True).over(back), F.first(value, True).over(ahead), F.first(at, True).over(ahead)


def fill(df: DataFrame, value: str, limit: int | None = C.GAP_LIMIT, both: bool = False, by: list[str] | None = None, order: str = "ts", step: int = 60 * C.STEP_MINUTES) -> DataFrame:
    """Linear filling along a regular axis.

    With a limit, the first ``limit`` rows of every gap are filled, also of longer ones; a gap at the end repeats the last value for as
    many rows, and one at the start stays. Without a limit and with ``both``, ends take the nearest value.
    """
    by = [SERIES] if by is None else by
    before, t0, after, t1 = _around(value, by, order)
    number = lambda c: F.unix_timestamp(c) if order == "ts" else c
    with_ends = df.withColumns({"_v0": before, "_t0": number(t0), "_v1": after, "_t1": number(t1)})
    now = number(F.col(order))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (now - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    inner = F.coalesce(line, F.col("_v0"))
    if limit is not None:
        inner = F.when((now - F.col("_t0")) / step <= limit, inner)
    filled = F.coalesce(F.col(value), inner, F.col("_v1")) if both else F.coalesce(F.col(value), inner)
    return with_ends.withColumn(value, filled).drop("_v0", "_t0", "_v1", "_t1")


def local_parts(df: DataFrame, zone: str = C.ZONE) -> DataFrame:
    """Adds date_local, tod (hours), dow (Monday 0), month and year of the local wall clock."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts").cast("timestamp_ntz"))
    parts = {"date_local": F.to_date(local), "tod": F.hour(local) + F.minute(local) / 60.0, "dow": F.weekday(local), "month": F.month(local), "year": F.year(local)}
    return df.withColumns(parts)


def to_utc(local: Column, order: Column, by: list[Column], zone: str = C.ZONE) -> Column:
    """UTC of local wall-clock stamps: of an hour that occurs twice, rows from where the clock goes back in order are the later ones.

    Null where the stamp doesn't exist (the hour skipped in spring). Where the first pass through the repeated hour is missing whole, order
    can't tell, and the rows count as the first pass.
    """
    plain = F.to_utc_timestamp(local.cast("timestamp"), zone)
    back = lambda t: F.from_utc_timestamp(t, zone)
    later = plain + F.expr("interval 1 hour")
    exists = back(plain) == local.cast("timestamp")
    repeats = back(later) == local.cast("timestamp")
    hour = Window.partitionBy(*by, F.date_trunc("hour", local)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    second = F.coalesce(F.max(local).over(hour) >= local, F.lit(False))
    return F.when(exists, F.when(second & repeats, later).otherwise(plain))


def ordinal_utc(local_date: Column, position: Column, minutes: int, zone: str = C.ZONE) -> Column:
    """Local midnight plus a position in the day, which stays regular over clock changes."""
    midnight = F.to_utc_timestamp(local_date.cast("timestamp"), zone)
    return F.timestamp_seconds(F.unix_timestamp(midnight) + position * 60 * minutes)


def wall(date: Column, hour: int, zone: str = C.ZONE) -> Column:
    """The instant of a wall-clock hour on a date."""
    return F.to_utc_timestamp(date.cast("timestamp") + F.expr(f"interval {hour} hours"), zone)


def step_hours(df: DataFrame, rows: int = 200) -> DataFrame:
    """Median step of each series' first rows, in hours."""
    w = Window.partitionBy(SERIES).orderBy("ts")
    steps = df.select(SERIES, F.row_number().over(w).alias("n"), (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))).alias("s"))
    return steps.filter(F.col("n") <= rows).groupBy(SERIES).agg((F.median("s") / 3600).alias("step_hours"))


def hours_to_slots(hourly: DataFrame, slots: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Linear interpolation of hourly means to quarter hours, between the middles of the intervals; held beyond the ends.

    Each middle bounds a segment to the next; a slot finds its segment by the hour half an hour before its own middle, an equality.
    """
    by = [SERIES] if by is None else by
    w = Window.partitionBy(*by).orderBy("ts")
    segment = hourly.select(*by, F.col("ts").alias("hour"), *(F.col(v).alias(f"{v}_0") for v in values), *(F.lead(v).over(w).alias(f"{v}_1") for v in values), F.lead("ts").over(w).alias("next"))
    ends = hourly.groupBy(*by).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    at = F.unix_timestamp("ts") + 450 - 1800
    hour = F.timestamp_seconds(at - at % 3600)
    keyed = slots.join(ends, by).withColumn("hour", F.greatest(F.least(hour, F.col("_last")), F.col("_first"))).withColumn("_at", at)
    share = F.greatest(F.least((F.col("_at") - F.unix_timestamp("hour")) / (F.unix_timestamp("next") - F.unix_timestamp("hour")), F.lit(1.0)), F.lit(0.0))
    blend = {v: F.when(F.col("next").isNull(), F.col(f"{v}_0")).otherwise(F.col(f"{v}_0") + (F.col(f"{v}_1") - F.col(f"{v}_0")) * share) for v in values}
    joined = keyed.join(segment, [*by, "hour"], "left")
    return joined.select(*slots.columns, *(c.alias(v) for v, c in blend.items()))


def doy_slot(ts: Column) -> tuple[Column, Column]:
    """Day of the year, at most 365, and the quarter-hour slot of the UTC day."""
    return F.least(F.dayofyear(ts), F.lit(365)), F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)


def history_frame(df: DataFrame, cutoff: Column, history_days: int, ahead_days: int, values: list[str]) -> DataFrame:
    """Axis of the days before and after a cutoff; measured values before it with gaps filled both ways, none after it."""
    bounds = df.select(SERIES).distinct().withColumn("_cut", cutoff)
    span = F.sequence(F.col("_cut") - F.expr(f"interval {history_days} days"), F.col("_cut") + F.expr(f"interval {ahead_days} days") - F.expr(STEP), F.expr(STEP))
    rows = bounds.select(SERIES, "_cut", F.explode(span).alias("ts")).join(df.select(SERIES, "ts", *values), [SERIES, "ts"], "left")
    past = rows.filter("ts < _cut")
    for v in values:
        past = fill(past, v, limit=None, both=True)
    future = rows.filter("ts >= _cut").withColumns({v: F.lit(None).cast("double") for v in values})
    return past.unionByName(future).drop("_cut")


def end_of_data(df: DataFrame) -> DataFrame:
    return df.groupBy(SERIES).agg((F.max("ts") + F.expr(STEP)).alias("data_until"))


def revisions(old: DataFrame, new: DataFrame, values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows that both snapshots hold and whose values changed, with the differences."""
    a = old.select(SERIES, "ts", *(F.col(v).alias(f"_{v}") for v in values))
    changed = new.join(a, [SERIES, "ts"]).withColumns({f"d_{v}": F.col(v) - F.col(f"_{v}") for v in values})
    most = F.greatest(*(F.abs(F.col(f"d_{v}")) for v in values), F.lit(0.0))
    return changed.filter(most > tolerance).select(SERIES, "ts", *(f"d_{v}" for v in values))
