"""Costly steps run once per query, with few tests per line, in methods that the virtual machine compiles."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from portcullis.dims.rules import default_rules
from portcullis.functions.patterns import best_piece, quick_part
from portcullis.functions.tables import shared
from portcullis.operators import details as DE, gates as G, matching as M, technology as TE
from portcullis.plans import scan as SC

COMPILED = 8000  # bytes of code beyond which the virtual machine only interprets a method


@pytest.fixture
def lines(spark):
    rows = [
        ("p", "a.py", "python", 1, "import structlog"),
        ("p", "a.py", "python", 2, "def f(x):"),
        ("p", "a.py", "python", 3, '    logger.info("login password=" + password)'),
        ("p", "a.py", "python", 4, ""),
        ("p", "b.java", "java", 1, '    logger.error("audit {} delete failed", id);'),
        ("q", "c.cs", "csharp", 9000, '    _logger.LogError("Order {Id} failed", id);'),
        ("q", None, "python", 3, "    print(token)"),
        (None, "a.py", "python", 3, "    print(token)"),
        ("q", "d.ts", "typescript", 1, None),
    ]
    return spark.createDataFrame(rows, "project_id string, path string, language string, line_no bigint, line string")


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def searches(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Generate explode(_hits")


def asked(lines):
    return M.match_gates(lines).select(*M.LINE_KEYS).distinct()


def test_context_searches_once(lines, plain_plans):
    assert searches(M.context_of(asked(lines), lines)) == 1


def test_function_anywhere_searches_once(lines, plain_plans):
    assert searches(M.with_function(asked(lines), lines, None)) == 1


def test_context_of_rows_without_a_key(lines):
    found = M.context_of(asked(lines), lines).collect()
    context = {(r.project_id, r.path, r.line_no): r.context_lines for r in found}
    assert context["p", "a.py", 3] == ["import structlog", "def f(x):", '    logger.info("login password=" + password)', ""]
    assert context["q", None, 3] == [] and context[None, "a.py", 3] == []


def test_shared_results_are_the_results(lines):
    rows = lambda df: sorted(map(str, df.collect()))
    one, many = SC.scan_lines(lines, shared=True), SC.scan_lines(lines)
    assert one.results.schema == many.results.schema
    assert rows(one.results) == rows(many.results) and rows(one.scores) == rows(many.scores)


def test_details_search_no_more_for_scores(lines, plain_plans):
    sc = SC.scan_lines(lines, shared=True)
    found = DE.gate_details(sc.scores, sc.results, M.match_gates(lines), TE.detect_technologies(lines, "line"))
    assert searches(found) <= 3


def sizes(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]


def test_methods_of_the_search_are_compiled(lines, plain_plans):
    assert max(sizes(M.match_lines(lines.where("line_no > 0")))) <= COMPILED
    assert max(sizes(G.found_counts(M.match_gates(lines)))) <= COMPILED
    assert max(sizes(G.file_statistics(G.file_analyses(lines)))) <= COMPILED


def test_guards_share_tests():
    live = [(i, r) for i, r in enumerate(default_rules(languages=["python"])) if not r.dead and r.word is None]
    guards = M._regex_hits(live)
    assert len(M._guarded_arrays(guards, M.HIT_TYPE)) < len(guards) / 2


def test_every_guard_is_reached():
    """A text stands behind pieces of itself only, once."""

    def behind(texts, under=""):
        left, out = set(texts), {}
        while piece := best_piece(sorted(left), under):
            inside = {t for t in left if piece in t}
            assert inside and (len(inside) < len(texts) or not under)
            left -= inside
            out |= {t: (piece, *pieces) for t, pieces in behind(inside - {piece}, piece).items()} | ({piece: (piece,)} if piece in inside else {})
        return out | {t: (t,) for t in left}

    texts = {"logger.", "logger.info", "log", "retry", "@retry", "max_retries", "x", "xx", "xxx", "\u017f"}
    found = behind(texts)
    assert set(found) == texts and all(p in t for t, pieces in found.items() for p in pieces)


def test_known_hits_are_not_searched_again(spark, lines, plain_plans):
    hits = shared(M.search_lines(lines), *M.LINE_KEYS)
    scores = SC.scan_lines(lines, hits=M.with_gates(hits)).scores
    listed = M.with_rules(hits).join(scores.select("project_id", "gate", "status"), ["project_id", "gate"])
    counted = listed.groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"))
    assert searches(counted) == 1
    assert sorted(scores.collect(), key=str) == sorted(SC.scan_lines(lines).scores.collect(), key=str)


def test_guards_begin_with_a_rare_letter():
    for rule in default_rules():
        for text in rule.anchors:
            assert text.endswith(quick_part(text)) and quick_part(text)
    assert quick_part("request_id").startswith("q") and quick_part("") == ""


def test_headers_are_looked_for_in_a_frame_that_only_grows(spark, lines, plain_plans):
    found = M.with_function(asked(lines), lines)
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in found._jdf.queryExecution().executedPlan().toString()
    rows = [("p", "a.py", "python", n, "def f(x):" if n in (2, 4) else "    print(x)") for n in range(1, 60) if n != 3]
    far = spark.createDataFrame(rows, lines.schema)
    got = {r.line_no: (r.function_line, r.distance_from_function) for r in M.with_function(far.select(*M.LINE_KEYS), far).collect()}
    assert got[1] == (0, 0) and got[2] == (2, 0) and got[4] == (4, 0) and got[52] == (4, 48) and got[53] == (0, 0)
