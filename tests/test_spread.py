"""Tasks grow in number with a source, not in length."""

from pyspark.sql import functions as F

from portcullis.functions.tables import spread


def test_more_tasks_for_a_larger_source(spark, tmp_path):
    counts = []
    for n in (1_000, 8_000):
        made = spark.range(n, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
        made.write.parquet(str(tmp_path / str(n)))
        read = spark.read.parquet(str(tmp_path / str(n)))
        dealt = spread(read, at_least=2, piece=32 << 10)
        counts.append(dealt.rdd.getNumPartitions())
        assert {tuple(r) for r in dealt.collect()} == {tuple(r) for r in read.collect()} and dealt.count() == n
    assert counts[0] >= 2 and counts[1] >= 4 * counts[0]
