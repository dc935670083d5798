"""Row numbers and neighbour frames that hold when one key has a large share of the rows."""

from pyspark.sql import DataFrame, Window, functions as F


def numbered(df: DataFrame, keys, position, block=65_536, name="row_no", partitions=None):
    """1-based row number per key in the order of the integer column ``position`` (unique per key).

    Rows are counted per (key, block of positions); only these counts are ordered per key. The row
    numbers inside a block then need at most ``block`` rows in one task, however large a key is.
    With ``partitions`` the one shuffle keeps that many partitions, for costly work that follows.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    if partitions:
        blocked = blocked.repartition(partitions, *keys, "_block")
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_block", "_before")
    )


def with_halo(lines: DataFrame, keys, position, before, after, block):
    """Copies rows near a block border into the neighbouring block.

    A window over (keys, ``_block``) then sees every row up to ``before`` positions back and ``after``
    ahead without ever holding a whole key. Copies carry ``_own = false``.
    """
    home = F.floor(F.col(position) / block)
    blocks = F.array_distinct(
        F.array(home, F.floor((F.col(position) + before) / block), F.floor((F.col(position) - after) / block))
    )
    return lines.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == home)


def top_per(df: DataFrame, keys, order, k, name="rank"):
    """The first ``k`` rows per key; Spark keeps at most ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def with_previous(df: DataFrame, keys, time, tie, value, block_seconds, name="previous"):
    """The value of the row before, per key in order of (time, tie), without a window over a whole key.

    Rows are ordered inside blocks of time; the last value of each block is carried to the next block
    that has rows of the key. Only one row per key and block is ordered per key.
    """
    blocked = df.withColumn("_block", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / block_seconds))
    last = blocked.groupBy(*keys, "_block").agg(F.max_by(F.struct(value), F.struct(time, tie)).alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy("_block")
    carried = last.select(*keys, "_block", F.lag("_last").over(by_key).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(time, tie)
    joined = blocked.join(carried, [*keys, "_block"]).withColumn("_before", F.lag(F.struct(value)).over(inside))
    return joined.withColumn(name, F.coalesce("_before", "_carried")[value]).drop("_block", "_carried", "_before")
