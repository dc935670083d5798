"""A filter of fixed size in front of a join, so that rows without a partner are not shuffled."""

from pyspark.sql import DataFrame, functions as F

#: Bits of a sieve; 64 of them make one row, so that it has at most 131,072 rows of two numbers.
BITS = 1 << 23


def _position(keys):
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def sieve(wanted: DataFrame, keys) -> DataFrame:
    """One bit for each hash of the keys of ``wanted``: rows (_word, _bits), however many rows there are."""
    bits = wanted.select(_position(keys).alias("_at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_at") % 64).cast("int"))
    return bits.select(F.floor(F.col("_at") / 64).alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def sifted(rows: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    """Rows that may have a partner in ``wanted`` by equal keys: all that have one, and few others.

    The sieve has a fixed size and is broadcast, so it can stand in front of a join of any size: rows that it holds back
    are dropped where they are read. When more keys are wanted than it has bits, it holds back little, and the join
    then needs most rows anyway.
    """
    placed = rows.withColumn("_at", _position(keys)).withColumn("_word", F.floor(F.col("_at") / 64))
    bit = F.call_function("shiftright", F.col("_bits"), (F.col("_at") % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return placed.join(F.broadcast(sieve(wanted, keys)), "_word").where(bit == 1).select(*rows.columns)
