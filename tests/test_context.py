"""Function and context lines of some rows, gathered by their numbers."""

import random

import pytest
from pyspark.sql import functions as F

from portcullis.functions.sifting import sieve, sifted
from portcullis.operators import matching as M
from portcullis.sources.files import explode_lines, files_from_table

SCHEMA = "project_id string, path string, language string, line_no bigint, line string"


def table(spark, n=3000, hot=2500, seed=1):
    """A hot file, some small ones, and headers far apart."""
    rng = random.Random(seed)
    rows = [("p", "hot.py", "python", i, f"def f{i}():" if i % 997 == 5 else f"x{rng.randrange(9)}") for i in range(1, hot + 1)]
    rows += [("p", f"s{i % 9}.py", "python", i // 9 + 1, "def g():" if i % 31 == 0 else "y") for i in range(n - hot)]
    return rows


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_function_however_far_back(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SPAN", 3)
    rows = table(spark)
    lines = spark.createDataFrame(rows, SCHEMA)
    asked = lines.select(*M.LINE_KEYS).where("line_no % 7 = 3 or path <> 'hot.py'")
    got = {(r.path, r.line_no): (r.function_name, r.function_line, r.distance_from_function) for r in M.with_function(asked, lines, None).collect()}
    headers = {}
    for _, path, _, n, line in sorted(rows, key=lambda r: (r[1], r[3])):
        last = headers.get((path, n - 1), ("unknown", 0))
        headers[path, n] = (line[4:-3], n) if line.startswith("def") and n >= 2 else last
    assert got == {k: (headers[k][0], headers[k][1], k[1] - headers[k][1] if headers[k][1] else 0) for k in got} and len(got) > 700
    if block <= 48:  # a limited look-back needs blocks that are longer
        return
    near = {(r.path, r.line_no): r.function_line for r in M.with_function(asked, lines).collect()}
    assert all(near[k] == (headers[k][1] if k[1] - headers[k][1] <= 48 else 0) for k in got)


def test_long_function_keeps_its_name(spark):
    text = "import os\ndef long():\n" + "    x\n" * 9000 + "    timeout = 30"
    lines = spark.createDataFrame([("p", "a.py", "python", n, x) for n, x in enumerate(text.split("\n"), 1)], SCHEMA)
    asked = lines.where("line like '%timeout%'").select(*M.LINE_KEYS)
    assert M.with_function(asked, lines, None).first().function_name == "long"
    assert M.with_function(asked, lines).first().function_name == "unknown"


def test_context_of_some_rows(spark):
    lines = spark.createDataFrame(table(spark), SCHEMA)
    every = {(r.path, r.line_no): (r.context_lines, r.context_start_line, r.context_end_line) for r in M.with_context_lines(lines).collect()}
    asked = lines.where("line_no % 50 in (1, 2) or path = 's3.py'").select(*M.LINE_KEYS, F.lit("k").alias("kept"))
    got = M.context_of(asked.unionByName(asked), lines).collect()
    assert len(got) == 2 * asked.count() and all(every[r.path, r.line_no] == (r.context_lines, r.context_start_line, r.context_end_line) and r.kept == "k" for r in got)
    gone = spark.createDataFrame([("p", "hot.py", 10**6, "k"), (None, "hot.py", 1, "k")], "project_id string, path string, line_no bigint, kept string")
    assert [r.context_lines for r in M.context_of(gone, lines).collect()] == [[], []]
    assert M.context_of(asked.limit(0), lines).count() == 0 and M.context_of(asked, lines.limit(0)).where("size(context_lines) > 0").count() == 0


def test_shuffled_lines_grow_with_the_hits(spark):
    """Of a hundred thousand lines, little more than those around the hits pass the filter."""
    lines = spark.range(100_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("f"), (F.col("id") % 10).cast("string")).alias("path"), F.floor(F.col("id") / 10).alias("line_no"), F.lit("x").alias("line"))
    wanted = lines.where("line_no % 1000 = 7").select(*M.LINE_KEYS)
    assert 100 <= sifted(lines, wanted, M.LINE_KEYS).count() <= 110
    assert sifted(lines, wanted, M.LINE_KEYS).join(wanted, M.LINE_KEYS).count() == 100
    assert sieve(lines, M.LINE_KEYS).count() <= 1 << 17
    plan = M.context_of(wanted, lines)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_context_of_files_needs_no_join(spark):
    texts = ["a\nb\nc\nd\ne\nf\ng\nh\ni", "", "one", None, "x\n\n\n"]
    files = files_from_table(spark.createDataFrame([("p", f"{i}.py", t) for i, t in enumerate(texts)], "p string, f string, t string"), "p", "f", "t")
    plain, around = explode_lines(files), explode_lines(files, around=3)
    want = {(r.path, r.line_no): (r.context_lines, r.context_start_line, r.context_end_line) for r in M.with_context_lines(plain).collect()}
    got = {(r.path, r.line_no): (r.context_lines, r.context_start_line, r.context_end_line) for r in around.collect()}
    assert got == want and "Exchange" not in around._jdf.queryExecution().executedPlan().toString()
