"""The join of lines with rules that are known as a table only."""

import random

from pyspark.sql import functions as F

from portcullis.operators import joins as J, matching as M

LINES = "project_id string, path string, language string, line_no bigint, line string"
RULES = "rule_no int, gate string, rule_language string, rule_id string, pattern string"


def lines_of(spark, texts, language="python"):
    return spark.createDataFrame([("p", "f", language, n, t) for n, t in enumerate(texts, 1)], LINES)


def test_many_rules(spark):
    """Twenty thousand rules plan and run; lines meet only the rules whose text they may contain."""
    rules = spark.range(20_000).select(
        F.col("id").cast("int").alias("rule_no"), F.lit("g").alias("gate"), F.lit("python").alias("rule_language"), F.col("id").cast("string").alias("rule_id"),
        F.concat(F.lit("need"), F.conv(F.col("id") * 7919 + 10**6, 10, 36), F.lit(r"\s*=")).alias("pattern"),
    )
    names = {r.rule_no: r.pattern[4:-4] for r in rules.where("rule_no % 100 = 0").collect()}
    lines = lines_of(spark, [f"xx NEED{name.lower()} = 1" for name in names.values()] + ["nothing here"] * 300 + [None, ""])
    found = J.j1_lines_rules(lines, J.with_guards(rules))
    assert {r.rule_no for r in found.collect()} == set(names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_rules_of_any_guard(spark):
    """Long, short and no guards, other languages, rules that cannot match, rows that repeat."""
    rng = random.Random(3)
    patterns = ["abc+d", "a", r"\d", "(x|y)z", "ab", "abcd", "Q+", r"\w+\(", r"a\nb", "", "x*", None]
    rules = spark.createDataFrame([(i, "g", lang, f"{lang}{i}", p) for lang in ("python", "java") for i, p in enumerate(patterns)], RULES)
    texts = ["".join(rng.choice("abcdxyzQ1( ") for _ in range(rng.randrange(0, 12))) for _ in range(150)] + ["", None, "ABCD", "abcd"]
    lines = lines_of(spark, texts + texts[:20]).unionByName(lines_of(spark, texts, "java")).unionByName(lines_of(spark, texts, "cobol"))
    got = sorted((r.language, r.line_no, r.rule_id) for r in J.j1_lines_rules(lines, J.with_guards(rules)).collect())
    live = rules.where("pattern is not null and pattern <> '' and pattern <> 'x*'").withColumnRenamed("rule_language", "language")
    want = lines.join(live, "language").where(F.rlike("line", F.concat(F.lit("(?i)"), F.col("pattern"))) & ~F.col("pattern").contains(r"\n"))
    assert got == sorted((r.language, r.line_no, r.rule_id) for r in want.collect()) and len(got) > 300


def test_own_rules_as_a_table(spark):
    texts = ["logger.info('password=' + password)", "timeout = 30", "x = 1", "@retry(max_retries=3)"]
    lines = lines_of(spark, texts)
    got = sorted((r.line_no, r.rule_id) for r in J.j1_lines_rules(lines, J.guarded_rules(spark)).collect())
    assert got == sorted((r.line_no, r.rule_id) for r in M.match_lines(lines).collect()) and got
