"""Columns of a hit, function context and surrounding lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from portcullis.dims.languages import HEADER_PATTERNS
from portcullis.functions import ranking as K
from portcullis.operators import matching as M

SCHEMA = "project_id string, path string, language string, line_no bigint, line string"


def file_lines(text, language="python", path="f"):
    return [("p", path, language, i, t) for i, t in enumerate(text.split("\n"), 1)]


def test_known_hits(spark):
    text = "\n".join(["# a"] * 3 + ["def process_user_data(x):"] + ["    pass"] * 3 + ['    logger.info(f"Processing user {x} and more things of this line that are long")'])
    rows = M.full_matches(spark.createDataFrame(file_lines(text), SCHEMA)).where("gate = 'audit_trail'").collect()
    (hit,) = [r for r in rows if "admin" in r.pattern]
    assert (hit.line_no, hit.column_start, hit.column_end) == (8, 4, 33)
    assert hit.matched_text == 'logger.info(f"Processing user'
    assert (hit.pattern_type, hit.category, hit.severity, hit.priority) == ("logging", "logging", "LOW", 2)
    assert (hit.function_name, hit.function_line, hit.distance_from_function) == ("process_user_data", 4, 4)
    assert (hit.indentation_level, hit.context_start_line, hit.context_end_line, len(hit.context_lines)) == (4, 5, 8, 4)


def test_general_hit(spark):
    lines = spark.createDataFrame(file_lines("x\ndef background_job():\n        time.sleep(1000)"), SCHEMA)
    hit = M.full_matches(lines).where("gate = 'retry_logic'").first()
    assert (hit.matched_text, hit.column_start, hit.column_end, hit.line_length) == ("time.sleep(", 8, 19, 24)
    assert (hit.pattern_type, hit.severity, hit.priority, hit.function_name) == ("general", "MEDIUM", 5, "background_job")


def test_string_literal_and_comment(spark):
    rows = [(1, "# it's \\' logger.error(x)"), (2, "a = 'logger.error(x)'"), (3, '  // "a" logger.error(x)')]
    lines = spark.createDataFrame([("p", "f", "python", n, t) for n, t in rows], SCHEMA)
    got = {r.line_no: (r.is_string_literal, r.is_comment) for r in M.describe(M.match_lines(lines)).where("gate = 'error_logs'").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, True)}


ORIGINAL = {
    **HEADER_PATTERNS,
    "java": [r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)*(\w+)\s*\(", HEADER_PATTERNS["java"][1]],
    "csharp": [r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:\w+\s+)*(\w+)\s*\(", HEADER_PATTERNS["csharp"][1]],
}


def nearest(lines, n, language):
    for i in range(n, max(1, n - 49), -1):
        text = lines[i - 1].strip()
        for p in ORIGINAL[language]:
            hit = re.search(p, text)
            if hit:
                return hit.group(1), i, text, n - i
    return "unknown", 0, "", 0


@pytest.mark.parametrize("block", [4096, 60])
def test_function_and_context_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rnd, rows, want = random.Random(block), [], {}
    heads = ["def f%d(x):", "class C%d:", "public static void go%d (int a)", "publicfoo%d(", "function w%d()", "export class K%d", "const q%d = 1", "a%d b c ( d", "internal class Z%d", "obj%d : function"]
    for path, language in enumerate(HEADER_PATTERNS):
        lines = [rnd.choice(heads) % rnd.randint(0, 99) if rnd.random() < 0.03 else rnd.choice(["", "  x = 1", "y"]) for _ in range(400)]
        for n, t in enumerate(lines, 1):
            rows.append(("p", str(path), language, n, t))
            want[(str(path), n)] = (*nearest(lines, n, language), tuple(lines[max(0, n - 4) : n + 3]), max(1, n - 3), min(len(lines), n + 3))
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.with_function(M.with_context_lines(df), df).collect()
    assert len(got) == len(rows)
    for r in got:
        have = (r.function_name, r.function_line, r.function_signature, r.distance_from_function, tuple(r.context_lines), r.context_start_line, r.context_end_line)
        assert have == want[(r.path, r.line_no)]


def test_row_numbers_in_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7 % 1000).alias("pos"))
    got = {(r.k, r.pos): r.row_no for r in K.numbered(df, ["k"], "pos", block=16).collect()}
    for k in (0, 1):
        order = sorted(p for kk, p in got if kk == k)
        assert [got[(k, p)] for p in order] == list(range(1, len(order) + 1))


def test_previous_values_in_blocks(spark):
    df = spark.range(0, 300).selectExpr("id % 2 AS k", "id", "timestamp_seconds(CAST(id * 37 % 5000 AS BIGINT)) AS ts", "CAST(id AS DOUBLE) AS v")
    rows = K.with_previous(df, ["k"], "ts", "id", "v", 100, "before").collect()
    for k in (0, 1):
        mine = sorted((r.ts, r.id, r.v, r.before) for r in rows if r.k == k)
        assert [m[3] for m in mine] == [None] + [m[2] for m in mine[:-1]]
