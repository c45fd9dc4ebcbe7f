"""Written tables: intermediate ones in the shared folder, parameters, and idempotent output archives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local master; elsewhere that
    would be a folder of one machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> str:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: cuts the lineage of iterations and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def dropped(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def save_params(params: DataFrame, path: str) -> None:
    """Parameters of each series, one folder for each fit; an earlier fit of the same instant is replaced."""
    params.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fitted_at").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """The latest parameters of each series."""
    p = spark.read.parquet(path)
    rest = [c for c in p.columns if c != "series_id"]
    return p.groupBy("series_id").agg(F.max_by(F.struct(*rest), "fitted_at").alias("_p")).select("series_id", "_p.*")


def archive(forecast: DataFrame, path: str) -> None:
    """One immutable folder for each issue; writing an issue again gives the same folder."""
    forecast.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issued_at").parquet(path)


def decimal_commas(df: DataFrame, places: int) -> DataFrame:
    """Its numbers as text of so many places."""
    numbers = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    comma = lambda c: F.regexp_replace(F.format_string(f"%.{places}f", c), r"\.", ",")
    return df.select(*(F.when(F.col(c).isNotNull(), comma(c)).alias(c) if c in numbers else F.col(c) for c in df.columns))


def export_csv(df: DataFrame, path: str, places: int = 3) -> None:
    """Semicolons and decimal commas; for bounded reports, one file."""
    decimal_commas(df, places).coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def export_history(df: DataFrame, path: str, places: int = 3) -> None:
    """A csv file in order of time for each series and year (of ``date_local``), in a folder for each; a repeated run replaces the same ones."""
    rows = df.withColumn("year", F.year("date_local")).repartition("series_id", "year").sortWithinPartitions("series_id", "year", "ts")
    kept = decimal_commas(rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), places)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series_id", "year").option("sep", ";").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_backtest(forecasts: DataFrame, params: DataFrame, coefs: DataFrame, path: str) -> None:
    """A backtest's forecasts by issue, its shapes, and the correction's coefficients; a repeated run replaces the same issues."""
    forecasts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue").parquet(f"{path}/forecasts")
    params.write.mode("overwrite").parquet(f"{path}/shapes")
    coefs.write.mode("overwrite").parquet(f"{path}/coefficients")


def save_cube(cube: DataFrame, path: str) -> None:
    """Issues and horizons, one folder for each horizon, as corrections read them."""
    cube.repartition("h").write.mode("overwrite").partitionBy("h").parquet(path)


def scenario_table(scenarios: DataFrame, shifts: list[int], value: str = "pred", keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """One column for each scenario, named by its shift."""
    wide = scenarios.groupBy(*keys).pivot("shift", shifts).agg(F.first(value))
    return wide.select(*keys, *(F.col(str(k)).alias(f"scenario_{'m' if k < 0 else 'p'}{abs(k)}") for k in shifts))
