"""Pattern tests of whole texts against Python's own regular expressions."""

import re

from pyspark.sql import functions as F

from portcullis.dims import technologies as T
from portcullis.functions.patterns import guarded
from portcullis.functions.text import SPACE, folded, strip, strip_left
from portcullis.operators import technology as TE

TEXTS = ["import celery\nx", "an AWAIT here", "Background work\nno ta", "background of the TASK", "", None, "worker.py's", "it's \\ 'quoted'", "jobs in a queue", "ſchedule.every", "plain"]


def test_guarded_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, content string").withColumn("_low", folded("content"))
    patterns = [*T.BACKGROUND_PATTERNS, r"it's\s+\\"]
    rows = df.select("i", guarded("content", "_low", patterns).alias("found")).collect()
    for r in rows:
        text = TEXTS[r.i]
        expected = None if text is None else any(re.search(p, text, re.I | re.M) for p in patterns)
        assert r.found == expected, text


def test_patterns_are_literals(spark):
    """A pattern that comes from a row or a lambda is compiled anew for every text."""
    df = spark.createDataFrame([("p", "a", "python", "import flask")], "project_id string, path string, language string, content string")
    for made in (TE.has_background_jobs(df), TE.has_ui_components(df), TE.detect_technologies(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE lambda" not in plan and "RLIKE namedlambda" not in plan.replace("(", "")


def test_technologies_of_unknown_and_null(spark):
    rows = [("p", "python", "from flask import Flask"), ("p", "python", None), ("p", "cobol", "flask"), ("q", None, "flask"), ("q", "python", "nothing")]
    df = spark.createDataFrame(rows, "project_id string, language string, content string")
    found = {(r.project_id, r.language, r.category, r.technology) for r in TE.detect_technologies(df).collect()}
    expected = {("p", l, c, t) for l, c, t, p in T.technology_rules() if l == "python" and re.search(p, rows[0][2], re.I | re.M)}
    assert found == expected and found


def test_strip_takes_every_space(spark):
    texts = [chr(c) + "a" + chr(c) + "b" + chr(c) for c in range(1, 0x3001) if re.match(SPACE, chr(c)) or c % 97 == 0] + ["", " ", "\t\n a \r\n", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", ""), F.regexp_replace("t", f"^{SPACE}+", "")
    assert df.where((strip("t") != old[0]) | (strip_left("t") != old[1])).count() == 0
    assert "regexp_replace" not in df.select(strip("t"), strip_left("t"))._jdf.queryExecution().optimizedPlan().toString()
