"""Queries over their whole input, against their SQL twins."""

import pytest

from pyspark.sql import functions as F

from checks import queries
from checks.compare import difference, duck
from checks.oracle import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
WHOLE = [
    "j3_every_gate", "j7_report_runs", "j8_nearest_header", "r6_report_listing", "r7_expired_reports", "t3_sample_technologies", "u1_union_hits",
    "w4_newest_first", "x3_budget_samples",
]


def test_budget_reads_all_documents(spark, tmp_path):
    """More than ten short documents of a source fit; ids lie in several blocks, and one source is null."""
    rows = [(i * 700 - 3000, ["a", "b", None][i % 3], None if i % 50 == 7 else "x" * (0 if i % 11 == 5 else 37 * i % 2500)) for i in range(120)]
    rows += [(10**6 + i, "c", "y") for i in range(9000)] + [(10**6 + 9000 + i, "c", "z" * 2100) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want, length = set(), {}
    for doc, source, text in sorted(rows, key=lambda r: r[0]):
        sample = text if text is None or len(text) <= 2000 else text[:2000] + "... [truncated]"
        if sample is not None:
            length[source] = length.get(source, 0) + len(sample)
        if length.get(source, 15_001) <= 15_000:
            want.add((source, "error_logs", doc, sample, length[source]))
    got = [tuple(r) for r in QUERIES["x3_budget_samples"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and sum(r[0] == "c" for r in got) == 9002


def test_confidence_knows_manifests(spark, monkeypatch):
    ask = lambda: {(r.project_id, r.language): r.confidence for r in QUERIES["l5_language_confidence"](spark, SF).collect()}
    without, tree = ask(), queries.C.tree_files(spark, SF)
    named = tree.where("file_name = 'requirements.txt'").limit(1).withColumn("project_id", F.lit("proj0"))
    monkeypatch.setattr(queries.C, "tree_files", lambda spark, sf: tree.unionByName(named))
    more = {k: c - without[k] for k, c in ask().items() if c != without[k]}
    assert more == {("proj0", "python"): 20}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_input(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_expired_reports_split_the_table(spark):
    old = QUERIES["r7_expired_reports"](spark, SF).count()
    assert 0 < old < QUERIES["w4_newest_first"](spark, SF).count()
