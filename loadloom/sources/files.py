"""Readers of the input files: measured series, forecast archives, market and grid data."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadloom import config as C
from loadloom.operators import timeaxis as A
from loadloom.sources.store import dropped, exists


def number(c: str | Column) -> Column:
    """A number with a decimal comma or point; anything else is null."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def stamp(c: str | Column) -> Column:
    """'dd.MM.yyyy H:mm', or 'dd.MM.yyyy' at midnight, as a local wall-clock stamp."""
    parsed = F.coalesce(F.try_to_timestamp(c, F.lit("dd.MM.yyyy H:mm")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd H:mm")))
    return parsed.cast("timestamp_ntz")


def raw_csv(spark: SparkSession, path: str | list[str], names: list[str], skip: int = 0, nulls: tuple[str, ...] = (), header: bool = True, header_cell: str | None = None) -> DataFrame:
    """Strings by position, with the file and the row's place in it (ordered within a file). A BOM goes, and ``skip`` lines before the
    header; or, with ``header_cell``, all lines up to the first one of ten whose first cell it is.

    Lines are numbered in the first block of each file only, so a file isn't gathered in one task; elsewhere their place is enough.
    """
    start = F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"), start, F.monotonically_increasing_id().alias("pos"))
    lines = lines.select("line", "file", "start", F.struct("start", "pos").alias("place"))
    head = lines.filter("start = 0").withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("place")))
    if header_cell is None:
        head = head.filter(F.col("_n") > skip + int(header))
    else:
        is_header = (F.col("_n") <= 10) & (F.trim(F.split("line", ";")[0]) == header_cell)
        head = head.withColumn("_h", F.min(F.when(is_header, F.col("_n"))).over(Window.partitionBy("file"))).filter(F.col("_n") > F.coalesce("_h", F.lit(0)))
    kept = head.select("line", "file", "place").union(lines.filter("start > 0").select("line", "file", "place")).filter(F.length(F.trim("line")) > 0)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = kept.select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"sep": ";"}).alias("r"), "file", "place").select("r.*", "file", "place")
    return rows.withColumns({n: F.when(~F.col(n).isin(*nulls), F.col(n)) for n in names}) if nulls else rows


def series_csv(spark: SparkSession, path: str, values: list[str], series_id: str, zone: str = C.ZONE) -> DataFrame:
    """A local-time csv: series_id, ts (UTC) and values. The repeated autumn hour is told by order; rows of the hour that spring skips
    fail the read, as silently moving them would shift the series."""
    rows = raw_csv(spark, path, ["timestamp", *values]).withColumns({"_local": stamp("timestamp"), **{v: number(v) for v in values}})
    rows = rows.withColumn("ts", A.to_utc(F.col("_local"), F.col("place"), [F.col("file")], zone))
    bad = F.col("ts").isNull() & F.col("_local").isNotNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no such local time: "), F.col("timestamp"))).cast("timestamp")).otherwise(F.col("ts"))
    return rows.select(F.lit(series_id).alias("series_id"), checked.alias("ts"), *values).filter(F.col("ts").isNotNull())


def trim_after(df: DataFrame, kept: Column) -> DataFrame:
    """Rows up to the last one that ``kept`` holds for; templates after the real end go."""
    ends = df.filter(kept).groupBy("series_id").agg(F.max("ts").alias("_end"))
    return df.join(ends, "series_id").filter("ts <= _end").drop("_end")


def joined(load: DataFrame, meteo: DataFrame, values: tuple[str, ...] = ("temp", "sun", "wind"), limit: int = C.GAP_LIMIT) -> DataFrame:
    """Load with weather: both trimmed to their real ends, repeated weather stamps averaged, short gaps filled, rows with nulls dropped."""
    load = trim_after(load, F.col("load") > 0)
    weather = trim_after(meteo, F.col("temp").isNotNull()).groupBy("series_id", "ts").agg(*(F.avg(v).alias(v) for v in values))
    weather = A.on_axis(weather)
    for v in values:
        weather = A.fill(weather, v, limit)
    return load.join(weather, ["series_id", "ts"]).dropna()


def with_history(own: DataFrame, history: DataFrame, values: list[str]) -> DataFrame:
    """Earlier weather before the series' own: averaged, on an axis, filled."""
    first = own.groupBy("series_id").agg(F.min("ts").alias("_first"))
    old = A.on_axis(history.groupBy("series_id", "ts").agg(*(F.avg(v).alias(v) for v in values)))
    for v in values:
        old = A.fill(old, v)
    old = old.dropna(subset=values).join(first, "series_id").filter("ts < _first").drop("_first")
    return old.unionByName(own, allowMissingColumns=True)


def ordinal(rows: DataFrame, day: Column, minutes: int | Column, zone: str = C.ZONE) -> DataFrame:
    """UTC by a row's place among the rows of its local day."""
    w = Window.partitionBy("file", day).orderBy("place")
    return rows.withColumn("ts", A.ordinal_utc(day, F.row_number().over(w) - 1, minutes, zone))


def forecast_archive(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """Hourly archive by position: stamp, temperature, cloud cover, wind; repeated instants keep the first."""
    rows = raw_csv(spark, path, ["stamp", "temp", "cloud", "wind"]).withColumn("_day", F.to_date(stamp("stamp")))
    rows = ordinal(rows, F.col("_day"), 60).select(F.lit(series_id).alias("series_id"), "ts", "place", *(number(c).alias(c) for c in ("temp", "cloud", "wind"))).filter("temp is not null")
    keep = F.min_by(F.struct("temp", "cloud", "wind"), "place").alias("r")
    return rows.groupBy("series_id", "ts").agg(keep).select("series_id", "ts", "r.*")


def market(spark: SparkSession, paths: list[str], names: list[str], energy: bool) -> DataFrame:
    """Hourly values of files with one row a quarter or hour: energies are summed, other measures averaged; a later file wins.

    Lines before the header, whose first cell is "Den", are left out. The step follows from the number of rows of a day: more than 25
    are quarter hours. Name the columns that are wanted by position; others may follow in the file.
    """
    rows = raw_csv(spark, paths, ["day", "period", *names], header_cell="Den").withColumn("_day", F.to_date(stamp("day")))
    per_day = Window.partitionBy("file", "_day")
    rows = rows.withColumn("_step", F.when(F.count("*").over(per_day) > 25, 15).otherwise(60))
    rows = rows.withColumn("ts", A.floor_to(A.ordinal_utc(F.col("_day"), F.col("period").cast("int") - 1, F.col("_step")), 60))
    f = F.sum if energy else F.avg
    hourly = rows.groupBy("file", "ts").agg(*(f(number(n)).alias(n) for n in names))
    return hourly.groupBy("ts").agg(*(F.max_by(n, "file").alias(n) for n in names))


def grid_load(spark: SparkSession, path: str, with_pumping: bool = False) -> DataFrame:
    """Grid csv: two lines of preamble before the header, hourly, by position."""
    rows = raw_csv(spark, path, ["stamp", "pumped", "load"], skip=2)
    day = F.to_date(stamp(F.regexp_replace("stamp", r"(\d{2}\.\d{2}\.\d{4}).*", "$1")))
    rows = ordinal(rows.withColumn("_day", day), F.col("_day"), 60)
    return rows.select("ts", number("pumped" if with_pumping else "load").alias("load")).dropna()


def transparency(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Day-ahead and actual load by market time unit 'dd/MM/yyyy HH:mm - dd/MM/yyyy HH:mm'; hourly means, rows without values dropped."""
    rows = raw_csv(spark, [p for p in paths if "(" not in p.rsplit("/", 1)[-1]], ["mtu", "area", "actual", "ahead"], nulls=("-", "n/e"))
    clock = lambda k: F.to_timestamp(F.substring("mtu", k, 16), "dd/MM/yyyy HH:mm")
    rows = rows.withColumns({"_day": F.to_date(clock(1)), "_m": (F.unix_timestamp(clock(20)) - F.unix_timestamp(clock(1))) / 60})
    rows = ordinal(rows, F.col("_day"), F.when(F.col("_m") == 15, 15).otherwise(60))
    hourly = rows.groupBy(A.floor_to(F.col("ts"), 60).alias("ts")).agg(*(F.avg(number(c)).alias(c) for c in ("actual", "ahead")))
    return hourly.dropna(how="all", subset=["actual", "ahead"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of the files of a folder, as the key of a cached load."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "length", "modificationTime")


def manifest_key(spark: SparkSession, path: str) -> str:
    """One key for all files: it changes with any file's path, size or time."""
    one = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return manifest(spark, path).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ","), 256).alias("k")).first()["k"]


def stable_load(spark: SparkSession, path: str, read: Callable[[], DataFrame], cache: str, tries: int = 4, wait: float = 2.0) -> DataFrame:
    """The table that ``read`` makes of a folder's files, stored under their manifest's key; read again while files change underneath."""
    for _ in range(tries):
        key = manifest_key(spark, path)
        target = f"{cache.rstrip('/')}/{key}"
        if exists(spark, f"{target}/_SUCCESS"):
            return spark.read.parquet(target)
        read().write.mode("overwrite").parquet(target)
        if manifest_key(spark, path) == key:
            return spark.read.parquet(target)
        dropped(spark, target)
        time.sleep(wait)
    raise RuntimeError(f"files of {path} kept changing while they were read")


def workspace(root: str, name: str, fallback: str) -> str:
    """A configuration file of the workspace, or the common one."""
    own = Path(root) / "config" / name
    return str(own if own.exists() else Path(fallback) / name)
