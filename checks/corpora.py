"""The inputs of the registered queries, derived by Spark from the given tables.

* ``code_lines``: lines of source code templated from ``events``: one line per event, one file per user,
  eight projects, five languages. The same rows as the SQL in ``oracle.py``, but numbered so that a user
  with a large share of the events does not end in one task.
* ``text_files``: ``documents`` and ``pages`` as files.
* ``turn_lines``: ``conversations`` as lines.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from portcullis.functions.ranking import numbered
from portcullis.functions.tables import apart, spread
from portcullis.sources.files import files_from_table, lines_from_table, with_file_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CODE_KEYS = """
  concat('proj', CAST(user_id % 8 AS STRING)) AS project_id,
  concat('src/', role, '/', role, '_', CAST(user_id AS STRING), ext) AS path,
  language, role, user_id
"""
LINE_TEXT = """
CASE
  WHEN k = 10 THEN ''
  WHEN event_type = 'error' AND language = 'python' THEN concat('    logger.error("request failed", exc_info=True)  # ', k)
  WHEN event_type = 'error' AND language = 'java' THEN '    logger.error("audit {} delete failed", id);'
  WHEN event_type = 'error' AND language = 'csharp' THEN '    _logger.LogError("Order {Id} failed", id);'
  WHEN event_type = 'error' THEN '    console.error("request failed", err);'
  WHEN event_type = 'click' AND k < 4 THEN concat('    timeout = ', k, '0; opts = { timeout: 30 }')
  WHEN event_type = 'click' AND k < 8 THEN '    correlation_id = str(uuid.uuid4()); requestId = correlation_id'
  WHEN event_type = 'click' THEN '    # TODO @retry(max_retries=3) RetryPolicy with exponential backoff'
  WHEN event_type = 'view' AND k < 5 THEN concat('    return status_code=', CASE WHEN k = 1 THEN '404' WHEN k = 2 THEN '500' ELSE '200' END, '; res.status(404); return NotFound();')
  WHEN event_type = 'view' AND language = 'csharp' THEN '    _logger.LogInformation("request Delete received at endpoint")'
  WHEN event_type = 'view' THEN '    logger.info("request received at endpoint")'
  WHEN event_type = 'signup' AND k < 3 THEN '    logger.info("login password=" + password)'
  WHEN event_type = 'signup' AND k < 6 THEN '    console.log("token", token)'
  WHEN event_type = 'signup' THEN '    assert result; expect(result).toBe(1); assertTrue(result); Assert.True(result)'
  WHEN k < 3 THEN '    breaker = CircuitBreaker(failure_threshold=5, fallback=x); CircuitBreaker.of(x)'
  WHEN k < 6 THEN '    limiter = RateLimiter(rate_limit=10); throttle(1); Semaphore(3); SemaphoreSlim(2)'
  WHEN k = 6 AND language = 'csharp' THEN '    _logger.LogInformation("job started")'
  WHEN k = 6 THEN '    logger.info("job started")'
  WHEN k = 7 AND language = 'python' THEN 'import sentry_sdk'
  WHEN k = 7 AND language = 'java' THEN 'import io.sentry.Sentry;'
  WHEN k = 7 AND language = 'csharp' THEN 'using Sentry;'
  WHEN k = 7 THEN 'import * as S from "@sentry/browser";'
  WHEN k = 8 AND language = 'python' THEN '@app.errorhandler(404)'
  WHEN k = 8 AND language = 'java' THEN '@ExceptionHandler'
  WHEN k = 8 AND language = 'csharp' THEN '[ExceptionFilter]'
  WHEN k = 8 THEN '    window.onerror = report; const [error, setError] = useState("error")'
  WHEN language = 'python' THEN '    log = structlog.get_logger()'
  WHEN language = 'java' THEN '    MDC.put("correlationId", id);'
  WHEN language = 'csharp' THEN '    ILogger<Order> log;'
  ELSE '    logger.info({ id: 1 })'
END
"""
HEADER_TEXT = """
CASE language
  WHEN 'python' THEN concat('def ', CASE WHEN user_id % 3 = 0 THEN 'main' ELSE 'test_' END, role, '(self):')
  WHEN 'java' THEN concat('public void ', role, 'Api(')
  WHEN 'csharp' THEN concat('public class ', role)
  WHEN 'javascript' THEN concat('function ', role, 'Main(')
  ELSE concat('export class ', role)
END
"""


def _with_user_columns(df):
    by = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("user_id") % n + 1).cast("int"))
    return (
        df.withColumn("language", by(5, ["python", "java", "javascript", "typescript", "csharp"]))
        .withColumn("ext", by(5, [".py", ".java", ".js", ".ts", ".cs"]))
        .withColumn("role", by(7, ["service", "controller", "client", "test", "worker", "view", "util"]))
    )


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_user_columns(numbered(events, ["user_id"], "event_id", partitions=n)).withColumn("k", F.col("event_id") % 11)
    # The texts are columns of their own, apart from whole-stage code.
    header = apart(F.expr(f"CASE WHEN row_no = 1 THEN {HEADER_TEXT} END"), "row_no", F.lit(None))
    rows = rows.select("*", F.expr(LINE_TEXT).alias("own_text"), header.alias("header_text"))
    # The first row of a file brings the two lines above it along, so no second pass over the events is needed.
    own = "struct(CAST(2 + row_no AS BIGINT) AS line_no, own_text AS line)"
    above = (
        f"struct(CAST(1 AS BIGINT) AS line_no, concat('# generated ', role) AS line), "
        f"struct(CAST(2 AS BIGINT) AS line_no, header_text AS line)"
    )
    found = F.inline_outer(F.expr(f"CASE WHEN row_no = 1 THEN array({above}, {own}) ELSE array({own}) END"))
    keyed = rows.select("*", found).selectExpr(*_split(CODE_KEYS), "line_no", "line")
    return keyed.select("project_id", "path", "language", "line_no", "line")


def _split(text):
    """The select list, cut at top-level commas."""
    parts, depth, piece = [], 0, ""
    for ch in text.strip():
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(piece)
            piece = ""
        else:
            piece += ch
    return parts + [piece]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``code_lines`` without their text."""
    users = _with_user_columns(table(spark, sf_dir, "events").select("user_id").distinct())
    return with_file_columns(users.selectExpr(*_split(CODE_KEYS)).drop("role", "user_id"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return files_from_table(docs, "source", path, "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the host is the project, the rest of the address the path."""
    pages = spread(table(spark, sf_dir, "pages"))
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    route = F.regexp_extract("url", "^https?://[^/?#]*/?([^?#]*)", 1)
    path = F.concat(route, F.when(route.contains("."), F.lit("")).otherwise(F.lit(".p")), F.lit("#"), F.col("page_id").cast("string"))
    return files_from_table(pages, host, path, "html")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return lines_from_table(
        turns, F.lit("conversations"), F.col("conv_id").cast("string"), F.col("turn") + 1, "text", F.lit("python")
    )


# A project tree templated from ``orders``: one file per order, forty projects. The text is plain SQL for
# both engines.
TREE_SQL = """
SELECT concat('app', CAST(o_custkey % 40 AS VARCHAR(9))) AS project_id,
  concat(dir, CASE WHEN dir = '' THEN '' ELSE concat('d', CAST(k AS VARCHAR(20)), '/') END, name) AS path,
  name AS file_name, CAST(floor(o_totalprice * 10) AS BIGINT) AS size, o_orderdate AS modified,
  CASE name
    WHEN 'main.py' THEN concat('import os', chr(10), 'def run(x):', chr(10), '    print(x)', chr(10), 'from flask import Flask')
    WHEN 'App.java' THEN concat('package a.b;', chr(10), 'import java.util;', chr(10), 'public class App { @Test() }', chr(10), 'import org.junit.Test;')
    WHEN 'index.js' THEN concat('const a = require("express")', chr(10), 'function go() { console.log(a) }', chr(10), 'module.exports = go', chr(10), 'document.getElementById("a")')
    WHEN 'view.tsx' THEN concat('export class V {}', chr(10), 'import React from "react"', chr(10), 'let x: number = 1')
    WHEN 'Program.cs' THEN concat('using System;', chr(10), 'namespace A.B', chr(10), 'public class P', chr(10), 'ILogger<P> log;')
    WHEN 'notes' THEN CASE k % 4 WHEN 0 THEN concat('import os', chr(10), 'def f(x): print(x)') WHEN 1 THEN concat('interface A {', chr(10), 'type B = string') WHEN 2 THEN concat('crontab -e', chr(10), '<div><span>') ELSE 'nothing here' END
    WHEN 'package.json' THEN '{"dependencies": {"jquery": "1", "winston": "2"}}'
    WHEN 'requirements.txt' THEN concat('flask', chr(10), 'import pytest', chr(10), 'prometheus_client')
    WHEN 'pom.xml' THEN '<a>junit org.slf4j</a>'
    ELSE concat('text ', name) END AS content
FROM (
  SELECT o_orderkey AS k, o_custkey, o_totalprice, o_orderdate,
    CASE CAST(o_orderkey % 13 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN 'build/'
      WHEN 4 THEN 'docs/' WHEN 5 THEN 'lib/env/' WHEN 6 THEN '.git/' WHEN 7 THEN 'tests/' ELSE 'src/main/' END AS dir,
    CASE CAST(CAST(floor(o_orderkey / 13) AS BIGINT) % 17 AS INT) WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'requirements.txt'
      WHEN 3 THEN 'main.py' WHEN 4 THEN 'App.java' WHEN 5 THEN 'index.js' WHEN 6 THEN 'view.tsx' WHEN 7 THEN 'Program.cs'
      WHEN 8 THEN 'Mod.vb' WHEN 9 THEN 'README.md' WHEN 10 THEN 'run.test' WHEN 11 THEN 'notes' WHEN 12 THEN 'tool.csproj'
      WHEN 13 THEN 'style.css' WHEN 14 THEN '.bashrc' WHEN 15 THEN 'archive.TAR.gz' ELSE 'Dockerfile' END AS name
  FROM orders) o
"""

# Answers of a scoring model, templated from ``events``.
ANSWER_SQL = """
SELECT event_id, CASE
  WHEN event_type = 'view' THEN concat('Sure: {"quality_score": ', CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR(20)), ', "recommendations": ["use ', event_type, '", "log more"]} done')
  WHEN event_type = 'click' THEN concat('Quality Score: ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), '.5', chr(10), 'Recommendations:', chr(10), '- first of ', event_type, chr(10), '- second', chr(10), chr(10), 'The end')
  WHEN event_type = 'signup' THEN concat('1. Add structured logging to every service', chr(10), '* short', chr(10), '- Add correlation identifiers to all requests')
  WHEN event_type = 'error' THEN '{broken'
  ELSE concat('{"patterns_found": [], "n": ', CAST(event_id AS VARCHAR(20)), '}') END AS text
FROM events
"""


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portcullis.sources.files import known_language

    text = TREE_SQL.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {src}")
    files = spark.sql(text, src=spread(table(spark, sf_dir, "orders"))).drop("file_name")
    return with_file_columns(files).withColumn("language", known_language())


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ANSWER_SQL.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {src}")
    return spark.sql(text, src=table(spark, sf_dir, "events"))
