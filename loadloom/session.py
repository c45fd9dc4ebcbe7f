"""A session set up for time series: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loadloom", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    return SparkSession.builder.appName(app).config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
