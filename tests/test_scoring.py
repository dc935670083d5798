import random

import pytest
from pyspark.sql import functions as F

from portcullis.functions.text import fixed1
from portcullis.operators import gates as G, reports as R, scoring as A


@pytest.mark.parametrize(
    "gate,expected,found,quality,score,status",
    [
        ("audit_trail", 10, 2, 23.0, 12.54, "FAIL"),
        ("throttling", 2, 2, 100.0, 100.0, "PASS"),
        ("avoid_logging_secrets", 0, 25, 0.0, 0.0, "FAIL"),
        ("retry_logic", 0, 1, 75.0, 88.92, "PASS"),
        ("timeouts", 0, 1, 75.0, 82.08, "PASS"),
        ("correlation_id", 10, 20, 100.0, 100.0, "PASS"),
    ],
)
def test_known_scores(spark, gate, expected, found, quality, score, status):
    df = spark.createDataFrame([("p", gate, expected, found, quality)], "project_id string, gate string, expected bigint, found bigint, quality_score double")
    row = A.score_gates(df).first()
    assert row.final_score == pytest.approx(score) and row.status == status and 0 <= row.coverage <= 100


def test_quality(spark):
    rows = [("audit_trail", 5, 2, 6.0), ("audit_trail", 0, 0, 0.0), ("audit_trail", 0, 3, 9.0), ("avoid_logging_secrets", 0, 3, 0.0), ("timeouts", 1, 5, 20.0)]
    df = spark.createDataFrame(rows, "gate string, expected bigint, found bigint, bonus double")
    assert [r.q for r in df.select(G.quality_score().alias("q")).collect()] == [46.0, 100.0, 50.0, 70.0, 100.0]


def test_no_hits_no_bonus(spark):
    lines = spark.createDataFrame([("p", f"s{i}.py", "python", 1, "x") for i in range(3)], "project_id string, path string, language string, line_no bigint, line string")
    from portcullis.plans.scan import scan_lines

    scan = scan_lines(lines)
    results = {r.gate: r for r in scan.results.collect()}
    assert len(results) == 15
    assert results["structured_logs"].quality == 0.0 and results["structured_logs"].expected == 1
    assert results["avoid_logging_secrets"].quality == 100.0
    summary = scan.summary.first()
    assert (summary.total_files, summary.total_lines, summary.not_applicable_gates) == (3, 3, 3)


def test_one_decimal_as_printed(spark):
    rnd = random.Random(5)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 12.25, 12.35, 781.25, 99.95, 100.0, 1 / 3] + [rnd.randint(0, 40000) / 400 for _ in range(3000)] + [rnd.random() * 1e4 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(fixed1("v").alias("t")).collect()] == [f"{v:.1f}" for v in values]


def test_comments_hash(spark):
    import hashlib
    import json

    comments = {"timeouts": 'say "hi"', "audit_trail": "a\\b"}
    df = spark.createDataFrame([(comments,)], "comments map<string,string>")
    want = hashlib.md5(json.dumps(comments, sort_keys=True).encode()).hexdigest()[:8]
    assert df.select(R.comments_hash()).first()[0] == want


def test_more_than_a_hundred_files_count(spark):
    from portcullis.plans.scan import scan_lines

    rows = [("p", f"src/f{i:03}.py", "python", n, "x = 1") for i in range(130) for n in (1, 2)]
    lines = spark.createDataFrame(rows, "project_id string, path string, language string, line_no long, line string")
    every, capped = (scan_lines(lines, cap=c).summary.first() for c in (None, 100))
    assert (every.total_files, every.total_lines) == (130, 260)
    assert (capped.total_files, capped.total_lines) == (100, 200)
    assert scan_lines(lines).summary.first().total_files == 130
