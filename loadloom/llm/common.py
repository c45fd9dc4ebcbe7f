"""Shared pieces of the text operators: the shared folder, Arrow maps, Column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow map handles at a time, so that Python objects stay bounded.
ROWS_AT_ONCE = 256


class Tables:
    """The tables that one call writes. Calls in other threads have scopes of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, path: str) -> None:
        """A table that the call's result reads: it goes to the scope around, or stays where there is none."""
        self.kept.append(path)

    def drop(self, path: str) -> None:
        drop_table(self.spark, path)
        self.paths.remove(path)


_scope: ContextVar[Tables | None] = ContextVar("tables", default=None)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """Own what is written inside, in this thread. At the end all is dropped but what is kept; that belongs to the scope around. Results are
    lazy, so who calls an operator inside such a scope reads its rows there; called outside, the tables that its result reads stay."""
    own = Tables(spark)
    token = _scope.set(own)
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        _scope.reset(token)
        for path in own.paths:
            if path not in own.kept:
                drop_table(spark, path)
        if (around := _scope.get()) is not None:
            around.paths += own.kept


def shared_dir(spark: SparkSession) -> str:
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


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and a lost executor costs nothing."""
    return open_table(df.sparkSession, write_table(df, name), df)


def write_table(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _scope.get()) is not None:
        own.paths.append(path)
    return path


def open_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later step reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over small slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield fn(batch.slice(at, ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Each byte's stand-in in words of letters: A-Z in lower case, other letters and all bytes beyond ASCII themselves, the rest a space.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Runs of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]` in UTF-8, only A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def row_key(columns: list[str]) -> Column:
    """A 64-bit key of a row's content, for joining a decision back to its row beside doc_id."""
    return F.xxhash64(*columns)


def same(a: Column, b: Column) -> Column:
    """Equality that also holds between nulls, usable as a hash-join key."""
    return a.eqNullSafe(b)
