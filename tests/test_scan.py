"""The scan of files in one pass, and line tables that give the rows of whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from portcullis.dims import technologies as TD
from portcullis.dims.languages import CONTENT_PATTERNS
from portcullis.dims.technologies import technology_rules
from portcullis.functions.blocks import reach, text_blocks
from portcullis.operators import languages as L, technology as T
from portcullis.plans.scan import line_facts, scan_files
from portcullis.sources.files import explode_lines, files_from_table, read_source_tree

PYTHON = "import os\ndef f(x):\n    print(x)\nclass A(B):\n    pass\n"


def files(spark, *rows):
    """Files of (project, path, text)."""
    made = spark.createDataFrame(rows, "p string, f string, t string")
    return files_from_table(made, "p", "f", "t")


def gates(scan, column="status"):
    return {(r.project_id, r.gate): r[column] for r in scan.scores.collect()}


def summaries(scan):
    return {r.project_id: r for r in scan.summary.collect()}


def test_directories_of_the_whole_tree(spark):
    """A page directory or package without files of a detected language makes the gates of user interfaces apply."""
    scan = scan_files(
        files(
            spark,
            ("dir", "src/app.py", PYTHON), ("dir", "public/index.html", "<p>"),
            ("package", "src/app.py", PYTHON), ("package", "package.json", '{"Vue": "react", "a": "VUE"}'),
            ("deep", "src/app.py", PYTHON), ("deep", "a/public/x.html", "<p>"), ("deep", "b/package.json", '"react"'),
        )
    )
    status = gates(scan)
    assert status["dir", "ui_errors"] != "NOT_APPLICABLE" and status["package", "ui_error_tools"] != "NOT_APPLICABLE"
    assert status["deep", "ui_errors"] == status["deep", "log_background_jobs"] == "NOT_APPLICABLE"


def test_files_count_by_suffix(spark):
    scan = scan_files(files(spark, ("p", "src/app.py", PYTHON), ("p", "notes", PYTHON), ("p", "UPPER.PY", PYTHON), ("p", "x.py.txt", PYTHON)))
    assert (summaries(scan)["p"].total_files, summaries(scan)["p"].total_lines, summaries(scan)["p"].language) == (1, 5, "python")


def test_general_language_counts_other_files_too(spark):
    scan = scan_files(files(spark, ("p", "a.cs", "x\n\ny"), ("p", "b.vb", "z")), languages=["csharp", "dotnet"])
    assert (summaries(scan)["p"].total_files, summaries(scan)["p"].total_lines) == (3, 5)


def test_given_languages_without_files(spark):
    """A language that is asked for has results also where a project has no file of it."""
    both = scan_files(files(spark, ("p", "a.py", "x")), languages=["python", "java"]).results
    assert {(r.language, r.files) for r in both.select("language", "files").distinct().collect()} == {("python", 1), ("java", 0)}
    assert both.where("language = 'java' and gate <> 'avoid_logging_secrets'").select(F.max("expected"), F.min("quality")).first() == (0, 100.0)


def test_search_sees_what_filters_leave_out(spark):
    tree = files(spark, ("p", "src/a.py", PYTHON + "    timeout = 30\n"), ("p", "gen/b.py", "    timeout = 30\n" * 5))
    found = lambda **more: gates(scan_files(tree, exclude=["gen"], **more), "found")["p", "timeouts"]
    assert found() == 6 and found(search_scope="kept") == 1
    assert summaries(scan_files(tree, exclude=["gen"]))["p"].total_files == 1 and summaries(scan_files(tree, include=["*.java"]))["p"].total_files == 0


def test_cap_and_hot_project(spark):
    rows = [("hot", f"m{i:04d}.py", PYTHON) for i in range(300)] + [(f"p{i}", "a.py", PYTHON) for i in range(20)]
    tree = files(spark, *rows)
    assert summaries(scan_files(tree))["hot"].total_files == 300
    capped = summaries(scan_files(tree, cap=7))
    assert capped["hot"].total_files == 7 and capped["hot"].total_lines == 35 and capped["p3"].total_files == 1


def test_odd_files(spark):
    """No text, no language, one file twice, and no files at all."""
    odd = [("p", "a.py", None), ("p", "b.py", ""), ("p", "", "x"), ("p", "c.py", "y"), ("p", "c.py", "y"), ("none", "README", "x"), (None, "a.py", PYTHON)]
    got = {r.project_id: r.total_files for r in scan_files(files(spark, *odd)).summary.collect()}
    assert got == {"p": 4, None: 1}
    assert scan_files(files(spark, *odd).limit(0)).summary.count() == 0


def test_one_pass_over_the_text(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.py").write_text(PYTHON)
    scan = scan_files(read_source_tree(spark, str(tmp_path), 1))
    for table in (scan.results, scan.scores, scan.summary):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan|Scan binaryFile", plan)) == 1 and "Join" not in plan
    assert scan.summary.first().total_lines == 5


# Line tables


def test_blocks_have_the_lines_before_them(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["", "  ", "", "a", "b c"]) if i % 90 > 30 else "" for i in range(400)) for _ in range(4)]
    tree = files(spark, *[("p", f"{i}.py", t) for i, t in enumerate(texts)])
    got = {(r.path, r.block): (r.own, r.whole) for r in text_blocks(explode_lines(tree), 3, block=8).collect()}
    for i, text in enumerate(texts):
        lines = text.split("\n")
        for block in {n // 8 for n in range(1, len(lines) + 1)}:
            own = [x for n, x in enumerate(lines, 1) if n // 8 == block]
            before = [x for n, x in enumerate(lines, 1) if n // 8 < block and x.strip()][-3:]
            assert got.pop((f"{i}.py", block)) == ("\n".join(own), "\n".join(before + own) if any(x.strip() for x in own) else "\n".join(own))
    assert not got


def across(seed, pieces, n=300):
    """A text of pieces with line breaks, blanks and long runs of blank lines between them."""
    rng = random.Random(seed)
    return "".join(rng.choice(pieces) + rng.choice([" ", "\n", "\n\n", "  \n \n\t", "\n" * 700, "; "]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_signs_of_lines_are_those_of_files(spark, seed):
    pieces = ["import", "os", "public", "static", "void", "Main", "from", "x", "class", "A", "(", "package", "a.b;", "type", "=", ":", "interface", "{", "def", "f"]
    exts = [".py", ".java", ".js", ".ts", ".cs"]
    tree = files(spark, *[("p", f"{i}{exts[i % 5]}", across(seed * 100 + i, pieces, 12 + i)) for i in range(40)])
    whole = {r.path: r.n for r in tree.select("path", L.content_hits().alias("n")).collect()}
    lines = {r.path: r.content_matches for r in L.signs_of_lines(explode_lines(tree)).collect()}
    assert lines == whole and len(set(whole.values())) > 1
    assert sorted(L.content_score_of_lines(explode_lines(tree)).collect()) == sorted(L.content_score(tree).collect())


@pytest.mark.parametrize("seed", range(3))
def test_user_interface_of_lines_is_that_of_files(spark, seed):
    pieces = ["import", "React", "from", "'react'", "\"react\"", "x", "importReact", "reimport", "IMPORT", "re", "from", "y"]
    tree = files(spark, *[(f"p{i}", "a.py", across(seed * 100 + i, pieces, 5)) for i in range(60)])
    whole = sorted(T.has_ui_components(tree).collect())
    got = sorted(T.has_ui_components(explode_lines(tree).withColumn("content", F.lit(None).cast("string")), "line").collect())
    assert got == whole and 0 < sum(r.has_ui for r in whole) < 60
    facts = {r.project_id: r.has_ui for r in line_facts(explode_lines(tree)).collect()}
    assert facts == {r.project_id: r.has_ui for r in whole}


def test_import_that_goes_on(spark):
    tree = files(spark, ("yes", "a.py", "x\nimport" + "\n" * 3000 + "  React"), ("no", "a.py", "import\nx\nReact"))
    got = {r.project_id: r.has_ui for r in T.has_ui_components(explode_lines(tree), "line").collect()}
    assert got == {"yes": True, "no": False}


def test_other_signs_stay_in_a_line():
    """Technologies and background jobs need no neighbours."""
    assert reach([p for *_, p in technology_rules()]) == 0 and reach(TD.BACKGROUND_PATTERNS) == 0 and reach(TD.HTML_PATTERNS + TD.SCRIPT_PATTERNS) == 0
    assert reach([p for ps in CONTENT_PATTERNS.values() for p in ps]) == 3 and {len(c) for c in T.CROSSING} == {2}
    with pytest.raises(ValueError):
        reach([r"a[^b]*c"])
