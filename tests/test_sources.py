import json

import pytest
from pyspark.sql import functions as F

from portcullis.operators import filters as P, languages as L
from portcullis.plans.scan import scan_files
from portcullis.sources import files as S, report_files as RF


@pytest.fixture()
def tree(tmp_path):
    files = {
        "app/src/service.py": b'import os\nimport logging\ndef login(user):\n    logger.info("login password=" + password)\n    logger.error("x")\n',
        "app/src/client.py": b"def call():\n    requests.get(u, timeout=30)\n    time.sleep(3)\n",
        "app/web/index.html": b"<html><body></body></html>",
        "app/node_modules/x/big.js": b"console.log(1)\n",
        "app/empty.py": b"",
        "app/bad.py": b"print('\xff\xfe caf\xc3\xa9')\r\n",
        "app/requirements.txt": b"flask\n",
        "other/Main.java": b"public class Main {\n  public void run() { log.error(e); }\n}\n",
    }
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def test_read_tree(spark, tree):
    files = S.read_source_tree(spark, tree, project_depth=1)
    rows = {(r.project_id, r.path): r for r in files.collect()}
    assert ("app", "src/service.py") in rows and ("other", "Main.java") in rows and len(rows) == 7
    assert rows[("app", "bad.py")].content == "print(' café')\r\n"
    assert rows[("app", "bad.py")].language == "python" and rows[("app", "bad.py")].ext == ".py"
    assert {r.path for r in S.read_source_tree(spark, tree, project_depth=1, max_size=20).collect()} == {"node_modules/x/big.js", "bad.py", "requirements.txt"}
    lines = S.explode_lines(files)
    empty = spark.createDataFrame([("p", "empty.py", "")], "project string, path string, text string")
    (line,) = S.explode_lines(S.files_from_table(empty, "project", "path", "text")).collect()
    assert (line.line_no, line.line, line.language) == (1, "", "python")
    assert [r.line for r in lines.where("path = 'bad.py'").orderBy("line_no").collect()] == ["print(' café')\r", ""]


def test_scan_tree(spark, tree):
    scan = scan_files(S.read_source_tree(spark, tree, project_depth=1), languages=["python", "java"])
    found = {(r.project_id, r.gate): r.found for r in scan.scores.collect()}
    assert found[("app", "timeouts")] == 2 and found[("app", "error_logs")] == 1 and found[("other", "error_logs")] == 1
    assert found[("app", "avoid_logging_secrets")] > 0
    status = {(r.project_id, r.gate): r.status for r in scan.scores.collect()}
    assert status[("app", "avoid_logging_secrets")] == "FAIL" and status[("app", "ui_errors")] == "NOT_APPLICABLE"
    assert {r.project_id: r.total_files for r in scan.summary.collect()} == {"app": 3, "other": 1}


def test_detection(spark, tree):
    files = L.file_language(S.read_source_tree(spark, tree, project_depth=1))
    stats = L.language_statistics(P.prune_dirs(files))
    assert stats.count() == 12
    found = {(r.project_id, r.language) for r in L.detect_languages(stats).collect()}
    assert found == {("app", "python"), ("other", "java")}


@pytest.mark.parametrize(
    "url,enterprise,api,valid",
    [
        ("https://github.com/octocat/Hello-World", False, "https://api.github.com", True),
        ("https://github.com/microsoft/vscode.git", False, "https://api.github.com", True),
        ("https://github.abcd.com/company/repo", True, "https://github.abcd.com/api/v3", True),
        ("https://code.github.internal.com/internal/repo.git", True, "https://code.github.internal.com/api/v3", True),
        ("https://gitlab.com/user/repo", False, "https://gitlab.com/api/v3", False),
        ("https://github.com/onlyowner", False, "https://api.github.com", False),
    ],
)
def test_addresses(spark, url, enterprise, api, valid):
    row = P.classify_repo_url(spark.createDataFrame([(url,)], "url string")).first()
    assert (row.is_enterprise, row.api_base, row.is_valid) == (enterprise, api, valid)
    assert not (row.repo or "").endswith(".git")


def test_reports_round_trip(spark, tmp_path):
    from checks import queries as Q
    from portcullis.operators import reports as R, scoring as A

    sf = "/root/testdata/sf0.001"
    sc = Q.scan(spark, sf)
    gates = R.report_gates(sc.scores)
    reports = RF.json_reports(sc.summary, gates, R.report_summary(gates), A.project_findings(sc.scores), "2024-01-01 00:00:00")
    RF.write_json_reports(reports, str(tmp_path / "r"))
    back = RF.read_json_reports(spark, str(tmp_path / "r"))
    want = {r.project_name: r.overall_score for r in reports.collect()}
    assert {r.project_name: r.overall_score for r in RF.latest_reports(back).collect()} == want
    assert all(len(r.gates) == 15 and r.gates[0].name == "structured_logs" for r in back.collect())


def test_exchange_documents(spark, tmp_path):
    from checks import queries as Q

    results = RF.sarif_results(Q.full(spark, "/root/testdata/sf0.001"))
    docs = [json.loads(r.document) for r in RF.sarif_documents(results).collect()]
    assert all(d["version"] == "2.1.0" and d["runs"][0]["tool"]["driver"]["name"] for d in docs)
    assert sum(len(d["runs"][0]["results"]) for d in docs) == results.count()
    one = docs[0]["runs"][0]["results"][0]
    assert set(one) == {"ruleId", "level", "message", "locations", "properties"}
    RF.write_sarif(results, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == len(docs)
