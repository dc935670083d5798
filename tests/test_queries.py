"""A cross-section of the registered queries against their SQL twins; all of them with checks.compare."""

import pytest

from checks.compare import difference, duck
from checks.oracle import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "s2_files_from_table", "s3_explode_lines", "p1_exclude_paths", "p7_classify_repo_url", "l1_file_language", "l7_detect_languages",
    "m2_positions", "m11_function_context", "m13_priority", "j1_lines_rules", "g1_structured_logs", "g16_quality_score", "g19_violation_examples",
    "t1_detect_technologies", "t4_has_ui_components", "a8_gate_status", "a14_critical_issues", "w2_shown_hits", "w6_score_trend", "r4_report_rows",
    "r16_api_gates", "x2_relevant_samples", "x6_parse_recommendations", "st2_scan_status_latest",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_registry():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 120
