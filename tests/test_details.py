"""Details and advice beside the scores."""

from portcullis.operators import details as DE, gates as G, matching as M, technology as TE
from portcullis.plans.scan import scan_lines
from portcullis.sources import report_files as RF
from portcullis.operators import reports as R, scoring as A

SCHEMA = "project_id string, path string, language string, line_no bigint, line string"


def detailed(spark, texts):
    """Details by (project, gate) of files (project, path, language, text)."""
    rows = [(p, f, lang, n, line) for p, f, lang, text in texts for n, line in enumerate(text.split("\n"), 1)]
    lines = spark.createDataFrame(rows, SCHEMA)
    scan = scan_lines(lines)
    made = DE.gate_details(scan.scores, scan.results, M.match_gates(lines), TE.detect_technologies(lines, "line"))
    return scan, made, {(r.project_id, r.gate): (r.details, r.recommendations) for r in made.collect()}


def test_details_of_a_project(spark):
    leak = '    logger.info("password=" + password)'
    _, _, got = detailed(
        spark,
        [
            ("p", "src/a.py", "python", "import flask\nfrom flask import Flask\n" + "\n".join([leak] * 7)),
            ("p", "src/b.py", "python", "x = 1\ntimeout = 30\n    return status_code=404; res.status(404)\n    return status_code=503; res.status(404)"),
            ("p", "src/C.java", "java", "int x;"),
        ],
    )
    details, advice = got["p", "timeouts"]
    assert details[:2] == ["No timeout patterns found", "Found 1 timeout configurations"]
    assert details[-4:] == ["Found 1 pattern matches:", "📁 src/b.py:", "   Line 2: timeout = 30", details[-1]] and details[-1].startswith("   Pattern: ")
    assert len(advice) == len(set(advice)) > 0
    secrets = got["p", "avoid_logging_secrets"][0]
    n = int(secrets[1].split()[2])
    assert secrets[0] == "✅ No confidential data logging patterns detected" and n >= 7
    assert secrets[2] == "\n📊 Violations by Category:" and f"  ... and {n - 5} more violations" in secrets
    assert f"  🔴 CRITICAL Credentials & Passwords: {n} violations" in secrets and sum(t.startswith("   a.py:") for t in secrets) == 2
    assert f"Found {n} pattern matches:" in secrets and sum(t.startswith("   Line ") for t in secrets) == 3 and "   ... and 7 more matches" in secrets
    codes = got["p", "http_codes"][0]
    assert any(t.startswith("Status codes used: ") and "404" in t and "503" in t for t in codes)
    assert got["p", "ui_errors"] == (["Gate ui_errors is not applicable to this project type"], ["No action needed - ui_errors not relevant for this project"])


def test_hot_gate_keeps_few_hits(spark):
    """However many hits a gate has, only the first ones are gathered."""
    many = [("hot", f"f{i:03d}.py", "python", "\n".join(["timeout = 1"] * 200)) for i in range(50)]
    _, _, got = detailed(spark, many)
    details = got["hot", "timeouts"][0]
    assert "Found 10000 timeout configurations" in details and "📁 f000.py:" in details and "📁 f001.py:" not in details
    lines = spark.createDataFrame([(p, f, lang, n, x) for p, f, lang, t in many for n, x in enumerate(t.split("\n"), 1)], SCHEMA)
    assert max(len(r.picked) for r in DE.picked_hits(M.match_gates(lines)).collect()) <= 10
    facts = {(r.gate, r.language): r for r in DE.hit_facts(M.match_gates(lines)).collect()}
    assert (facts["timeouts", "python"].n, facts["timeouts", "python"].files) == (10_000, 50)


def test_details_reach_saved_reports(spark, tmp_path):
    scan, made, got = detailed(spark, [("p", "a.py", "python", "timeout = 30")])
    gates = R.report_gates(made)
    reports = RF.json_reports(scan.summary, gates, R.report_summary(gates), A.project_findings(scan.scores), "2024-01-01 00:00:00")
    RF.write_json_reports(reports, f"{tmp_path}/out")
    saved = RF.read_json_reports(spark, f"{tmp_path}/out").first()
    assert {g.name: g.details for g in saved.gates} == {gate: d for (_, gate), (d, _) in got.items()}
    view = {r.gate: r.details for r in R.api_gates(made).collect()}
    assert view["timeouts"] == got["p", "timeouts"][0][:5]


def test_no_hits_at_all(spark):
    _, _, got = detailed(spark, [("p", "a.py", "python", "x")])
    assert got["p", "http_codes"][0] == ["No HTTP status code patterns found"] and len(got) == len(G.D.GATES)
