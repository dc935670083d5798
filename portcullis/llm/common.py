"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many rows (of a few numbers each) a table may be broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 1_000_000

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without a cluster (tests), a folder of this process if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="llm-"))
    return _own_dir[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: later steps do not depend on lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand at most so many rows at once to Python in this session: whole texts take much memory there."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a saved table of narrow rows for broadcast if it has at most so many rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """A projection whose values are computed once a row, also where later lambdas use them for each element.

    Spark merges plain projections and would then compute them anew inside the lambda.
    """
    return df.select(F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_row")).select("_row.*")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def id_number(key: Column) -> Column:
    """A number from 0 to 2^60 that md5 gives for a key; the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def id_remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts
