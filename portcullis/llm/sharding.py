"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm.common import id_number, once

#: Slots of the table: a prime of more than 100 times the shards keeps shares within about one per cent.
SLOTS = 4099


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """The table (slot, shard): shards take turns, each claiming the first free slot in its order of preference.

    A shard prefers slots offset, offset + skip, offset + 2 skip ... modulo the prime table size, with offset and skip
    from its name, so its order is a permutation of all slots. A shard of weight w gets w turns in each round.
    Losing a shard moves its slots and few others. Each step of the fold looks at one slot; a claimed slot only moves
    the shard's pointer. shards: distinct names, at least one. The table depends on the shards alone, never on the data.
    """
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct names, with a positive weight each")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)) or len(shards) > min(slots, 65535):
        raise ValueError("slots must be a prime that is not below the number of shards")
    turns = [i for i, w in enumerate(weights) for _ in range(w)]
    names = spark.range(1).select(F.array(*map(F.lit, shards)).alias("names"), F.array(*map(F.lit, turns)).alias("turns"))
    prefs = once(
        names,
        names=F.col("names"),
        turns=F.col("turns"),
        starts=F.transform("names", lambda n: (id_number(F.concat(n, F.lit(":offset"))) % slots).cast("int")),
        skips=F.transform("names", lambda n: (id_number(F.concat(n, F.lit(":skip"))) % (slots - 1) + 1).cast("int")),
    )
    # A slot takes two bytes of the state; zero is free, else it holds the shard's number plus one.
    at = "transform(array(turns[acc.turn % size(turns)]), s -> named_struct('s', s, 'at', cast((starts[s] + cast(acc.seen[s] as bigint) * skips[s]) % {m} as int)))[0]"
    step = """transform(array({at}), p -> transform(array(substring(acc.held, 2 * p.at + 1, 2) = X'0000'), free -> named_struct(
        'held', if(free, overlay(acc.held placing unhex(lpad(hex(p.s + 1), 4, '0')) from 2 * p.at + 1 for 2), acc.held),
        'seen', transform(acc.seen, (n, i) -> if(i = p.s, n + 1, n)),
        'turn', if(free, acc.turn + 1, acc.turn)))[0])[0]"""
    fold = f"""aggregate(sequence(1, {len(shards) * slots}),
        named_struct('held', unhex(repeat('0000', {slots})), 'seen', transform(names, n -> 0), 'turn', 0),
        (acc, x) -> if(acc.turn = {slots}, acc, {step.format(at=at.format(m=slots))})).held"""
    numbers = f"transform(sequence(0, {slots - 1}), i -> cast(conv(hex(substring(held, 2 * i + 1, 2)), 16, 10) as int) - 1)"
    filled = once(prefs, names=F.col("names"), held=F.expr(fold))
    return once(filled, names=F.col("names"), numbers=F.expr(numbers)).select("names", F.posexplode("numbers").alias("slot", "number")).select("slot", F.expr("names[number]").alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """Every row with its slot and shard in place of columns of these names, found by one lookup in the broadcast table.

    A null key counts as empty text; equal keys meet in one shard. Rows are neither moved nor dropped, so a key that
    holds a third of all rows costs no more than others here; to spread such a key, place by (key, row id) instead.
    """
    rows = df.drop("slot", "shard").withColumn("slot", (id_number(F.col(key)) % slots).cast("int"))
    found = lookup_table(df.sparkSession, shards, slots, weights)
    return rows.join(F.broadcast(found), "slot")
