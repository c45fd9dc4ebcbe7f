"""The date dimension: holidays, bridges, periods, summer, day roles and irregular days. One row for each date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadloom import config as C


def easter_month_day(year: Column) -> tuple[Column, Column]:
    """Month and day of Easter Sunday, from the golden number, the century's corrections and the weekday of the full moon."""
    whole = lambda x, n: F.floor(x / n)
    golden, century, rest = year % 19, whole(year, 100), year % 100
    moon_shift = century - whole(century, 4) - whole(century - whole(century + 8, 25) + 1, 3)
    epact = (19 * golden + moon_shift + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * whole(rest, 4) - epact - rest % 4) % 7
    late = whole(golden + 11 * epact + 22 * weekday, 451)
    total = epact + weekday - 7 * late + 114
    return whole(total, 31).cast("int"), (total % 31 + 1).cast("int")


def easter(year: Column) -> Column:
    month, day = easter_month_day(year)
    return F.make_date(year.cast("int"), month, day)


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def feast_days(per_year: DataFrame, fixed: tuple[str, ...], after_easter: tuple[int, ...]) -> DataFrame:
    """Dates fixed in the year or counted from Easter Sunday."""
    fixed_days = F.array(*(F.make_date(F.col("year"), F.lit(int(d[:2])), F.lit(int(d[3:]))) for d in fixed))
    moving = F.array(*(F.date_add(easter(F.col("year")), k) for k in after_easter))
    return per_year.select(F.explode(F.array_union(fixed_days, moving)).alias("date")).distinct()


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    return feast_days(years(spark, first, last), C.FIXED_HOLIDAYS, C.EASTER_HOLIDAYS)


def shops_closed(spark: SparkSession, first: int, last: int) -> DataFrame:
    return feast_days(years(spark, first, last), C.SHOPS_CLOSED, C.SHOPS_CLOSED_EASTER)


def in_range(day: Column, first: str, last: str) -> Column:
    """Whether an 'MM-dd' string lies in a range, which may pass New Year."""
    return (day >= first) & (day <= last) if first <= last else (day >= first) | (day <= last)


def summer_length() -> int:
    (m0, d0), (m1, d1) = (tuple(map(int, x.split("-"))) for x in C.SUMMER_COURSE)
    return (date(2001, m1, d1) - date(2001, m0, d0)).days + 1


def summer_position(day: Column) -> Column:
    """Days since the start of the summer window, -1 outside of it; 29 February counts as the 28th."""
    m0, d0 = map(int, C.SUMMER_COURSE[0].split("-"))
    in_common_year = F.make_date(F.lit(2001), F.month(day), F.when(F.month(day) == 2, F.least(F.dayofmonth(day), F.lit(28))).otherwise(F.dayofmonth(day)))
    k = F.datediff(in_common_year, F.make_date(F.lit(2001), F.lit(m0), F.lit(d0)))
    return F.when((k >= 0) & (k < summer_length()), k.cast("double")).otherwise(-1.0)


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row for each date from ``first`` to ``last``: off, holiday, role (daytype), after_off, bridge and its length, periods,
    summer, irregular, context.

    Built on a calendar of whole days with a margin of 40 days, so that no attribute depends on which rows a series has.
    A daytype tells today's and tomorrow's role: 0 work-work, 1 work-off, 2 off-off, 3 off-work.
    A bridge is a run of at most two working days between days off, at least one neighbour of which is a holiday.
    """
    y0, y1 = int(first[:4]) - 1, int(last[:4]) + 1
    span = spark.sql(f"select explode(sequence(date'{first}' - 40, date'{last}' + 40, interval 1 day)) as date")
    days = span.join(F.broadcast(holidays(spark, y0, y1).withColumn("holiday", F.lit(True))), "date", "left").withColumn("holiday", F.coalesce("holiday", F.lit(False)))
    days = days.withColumn("off", F.col("holiday") | (F.weekday("date") >= 5))
    ordered = Window.orderBy("date")  # a calendar: some 365 rows a year, whatever the data
    days = days.withColumn("_run", F.sum(F.col("off").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumns({"_before": F.lag("holiday").over(ordered), "_after": F.lead("holiday").over(ordered), "off_before": F.lag("off").over(ordered), "off_after": F.lead("off").over(ordered)})
    run = Window.partitionBy("_run")  # working days after the same day off
    working = ~F.col("off")
    length = F.sum(working.cast("int")).over(run)
    by_holiday = F.max(working & ((F.col("_before") & F.col("off_before")) | (F.col("_after") & F.col("off_after")))).over(run)
    days = days.withColumn("bridge_len", F.when(working & (length <= C.LONGEST_BRIDGE) & by_holiday, length).otherwise(0).cast("int"))
    days = days.withColumn("bridge", F.col("bridge_len") > 0)
    mmdd = F.date_format("date", "MM-dd")
    flags = []
    for p in C.PERIODS:
        hit = F.lit(False)
        for a, b in p.ranges:
            hit = hit | in_range(mmdd, a, b)
        if p.bridges_only:
            hit = hit & F.col("bridge")
        if p.days != "all":
            hit = hit & (F.col("off") if p.days == "off" else working)
        flags.append(F.when(hit, F.lit(p.name)))
    special = F.col("holiday") | F.col("bridge")
    days = days.withColumns(
        {
            "daytype": F.when(working, F.when(F.col("off_after"), 1).otherwise(0)).otherwise(F.when(F.col("off_after"), 2).otherwise(3)),
            "after_off": F.col("off_before"),
            "periods": F.array_compact(F.array(*flags)),
            "summer_day": summer_position(F.col("date")),
            "summer_holiday": in_range(mmdd, *C.SUMMER_HOLIDAYS),
            "irregular": special | in_range(mmdd, *C.IRREGULAR_RANGE),
            "context": F.max(special | in_range(mmdd, *C.CONTEXT_RANGE)).over(ordered.rowsBetween(-C.CONTEXT_DAYS, C.CONTEXT_DAYS)),
        }
    )
    kept = ["date", "off", "holiday", "daytype", "after_off", "bridge", "bridge_len", "periods", "summer_day", "summer_holiday", "irregular", "context"]
    return days.filter(f"date between date'{first}' and date'{last}'").select(*kept)


def with_calendar(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Local time parts and the calendar of each row; the dimension is broadcast (some 365 rows a year)."""
    from loadloom.operators.timeaxis import local_parts

    return local_parts(df).join(F.broadcast(dimension.withColumnRenamed("date", "date_local")), "date_local", "left")


def clock_changes(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Last Sundays of March and October."""
    last_sunday = lambda m: F.next_day(F.date_sub(F.last_day(F.make_date(F.col("year"), F.lit(m), F.lit(1))), 7), "Sun")
    return years(spark, first, last).select("year", last_sunday(3).alias("spring"), last_sunday(10).alias("autumn"))


def christmas_group(day: Column) -> Column:
    """Labels of the days around Christmas, null elsewhere."""
    d = F.date_format(day, "MM-dd")
    named = [("12-24", "eve"), ("12-25", "day_1"), ("12-26", "day_2"), ("12-31", "new_years_eve"), ("01-01", "new_year")]
    out = F.when(d == named[0][0], named[0][1])
    for key, label in named[1:]:
        out = out.when(d == key, label)
    return out.when(in_range(d, "12-20", "12-23"), "before").when(in_range(d, "12-27", "12-30"), "between").when(in_range(d, "01-02", "01-06"), "after")


def season_year(day: Column) -> Column:
    """The year in which a winter season that passes New Year began."""
    return F.when(F.month(day) <= 6, F.year(day) - 1).otherwise(F.year(day))
