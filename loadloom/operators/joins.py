"""Joins by time ranges as equalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_before(left: DataFrame, right: DataFrame, at: str, other: str, seconds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows with ``other`` in the ``seconds`` up to ``at`` (the start excluded). The right rows lie in one time bucket each, a left row
    meets two; rows of a bucket meet only each other, whatever the length of the series."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    a = left.withColumn("_b", F.explode(F.array(bucket(at), bucket(at) - 1)))
    b = right.withColumn("_b", bucket(other))
    gap = F.unix_micros(at) - F.unix_micros(other)
    return a.join(b, [*by, "_b"]).filter((gap >= 0) & (gap < seconds * 1_000_000)).drop("_b")
