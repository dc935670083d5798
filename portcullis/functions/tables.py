"""Small fixed tables as DataFrames."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_ROWS = 100_000


def fixed_table(spark: SparkSession, ddl, rows) -> DataFrame:
    """A table of fixed values, for broadcast. The row count is checked, as it rides inside the plan."""
    if len(rows) > MAX_ROWS:
        raise ValueError(f"{len(rows)} rows; a fixed table may have at most {MAX_ROWS}")
    names = [part.strip().split()[0] for part in ddl.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    one = spark.range(1, numPartitions=1)
    return one.select(F.inline(F.from_json(F.lit(text), f"array<struct<{_typed(ddl)}>>")))


def _typed(ddl):
    return ",".join(":".join(part.strip().split(None, 1)) for part in ddl.split(","))


def computed_once(df: DataFrame, name, value) -> DataFrame:
    """Adds a costly column so that filters and joins on it do not evaluate its expression again.

    Filters are not pushed below a generator, while they would be copied into a plain projection.
    """
    return df.drop(name).select("*", F.explode_outer(F.array(value)).alias(name))


def restated(df: DataFrame, *columns) -> DataFrame:
    """The columns as given anew by a generator, below which filters are not pushed.

    A join drops rows without a key as early as it can. Where a costly table is on one side of such a join and also used
    elsewhere, that makes two different tables of it, and each is computed. With this between, one serves both.
    """
    return df.select(F.inline_outer(F.array(F.struct(*columns))))


def shared(df: DataFrame, *keys) -> DataFrame:
    """The rows of a costly table, shuffled once by ``keys``, which several tables then read.

    Each of them would otherwise have the table computed with just its own columns. Choose keys that spread the rows, and
    select the columns that are needed before.
    """
    return restated(df.repartition(*keys), *df.columns)


def apart(value, given, otherwise):
    """``value``, or ``otherwise`` where the column ``given`` is null.

    The lambda keeps the projection out of whole-stage code. A single method with many tests is too long for the virtual
    machine to compile, and is then interpreted row by row; outside, tests are compiled in small methods.
    """
    return F.when(F.exists(F.array(given), lambda x: x.isNull()), otherwise).otherwise(value)


#: Bytes of a source for one task of a search, which takes far longer than reading them.
PIECE = 4 << 20


def spread(df: DataFrame, at_least=None, piece=PIECE) -> DataFrame:
    """Spreads a source over the cores, and over more tasks as it grows, if it has fewer partitions.

    Searching is work for the processor, so a few small files would leave most cores idle, and partitions of the usual
    size would make tasks that take long. For plain scans only: partitions and bytes are counted without running anything.
    """
    cores = at_least or df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(cores, -(-size // piece))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
