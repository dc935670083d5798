"""The whole scan: lines or files in, gate scores and project summaries out.

A scan of files is one pass over the text; one of a line table reads it for file facts and for the search. Everything
after is a chain of small aggregates: language results, gate scores, project summaries. Each is derived from the one
before, so persisting or writing ``results`` makes all later tables cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..dims.gates import GATE_ORD
from ..functions.text import is_blank, lookup
from ..operators import entries as E, gates as G, languages as L, matching as M, scoring as A, technology as T


@dataclass
class Scan:
    """The tables of a scan. They are plans, not results: use or write those you need."""

    results: DataFrame  # project, gate, language
    scores: DataFrame  # project, gate
    summary: DataFrame  # project


def score_projects(results: DataFrame, applicable=None, compat=False) -> DataFrame:
    """Scores, status and order of all gates of a project."""
    scored = A.score_gates(A.combine_languages(results, compat))
    if applicable is None and "has_ui" in results.columns:
        applicable = T.applies()
    if applicable is not None:
        scored = A.mark_not_applicable(scored, applicable)
    return scored.withColumn("gate_ord", lookup("gate", GATE_ORD)).drop(*G.FLAGS)


SCORE_COLUMNS = [
    "project_id", "gate", "gate_ord", "expected", "found", "coverage", "quality_score", "final_score", "status",
]


def summarize(scores: DataFrame) -> DataFrame:
    """One row per project."""
    status = F.col("status")
    return scores.groupBy("project_id").agg(
        F.first("language").alias("language"),
        F.max("total_files").alias("total_files"),
        F.max("total_lines").alias("total_lines"),
        A.overall_value().alias("overall_score"),
        F.count_if(status == "PASS").alias("passed_gates"),
        F.count_if(status == "WARNING").alias("warning_gates"),
        F.count_if(status.isin("FAIL", "FAILED")).alias("failed_gates"),
        F.count_if(status == "NOT_APPLICABLE").alias("not_applicable_gates"),
    )


def line_facts(lines: DataFrame) -> DataFrame:
    """Facts of the files of a line table."""
    return T.file_facts(lines, "line", F.when(is_blank("line"), 0).otherwise(1))


def in_one(results: DataFrame) -> DataFrame:
    """The same rows, through one list per project (its gates and languages are few).

    Tables that are made from them need different columns, and Spark would compute the results anew for each set of
    columns. Of a list it computes all, once, and reads it several times.
    """
    own = [c for c in results.columns if c != "project_id"]
    listed = results.groupBy("project_id").agg(F.collect_list(F.struct(*own)).alias("_results"))
    return listed.select("project_id", F.inline("_results")).select(results.columns)


def _scan(facts, lines, rules, compat, gates, shared=False, hits=None):
    stats = G.file_statistics(facts, gates)
    found = G.found_counts(M.match_gates(lines, rules) if hits is None else hits, gates)
    results = G.gate_language_results(G.expected_counts(stats, gates), found, gates)
    results = in_one(results) if shared else results
    scores = score_projects(results, compat=compat)
    return Scan(results, scores.select(*SCORE_COLUMNS), summarize(scores))


def scan_lines(lines: DataFrame, rules=None, compat=False, gates=None, cap=None, shared=False, hits=None) -> Scan:
    """Scores every project of a line table (project_id, path, language, line_no, line).

    Expected counts are based on all files; ``cap`` limits them to so many files per language. The search sees all
    lines in either case. Say ``shared`` where a query uses several of the tables: they are then computed from results that
    are computed once. Give ``hits`` (keys, language, gate, matched text) where they are known: lines are then not searched.
    """
    return _scan(L.first_files(line_facts(lines), cap), lines, rules, compat, gates, shared, hits)


def scan_files(
    files: DataFrame, rules=None, exclude=(), include=(), max_size=None, languages=None, compat=False,
    cap=None, search_scope="all", chars=None,
) -> Scan:
    """Scores every project of a file table, in one pass over the text.

    Languages are detected per project unless given. Filters and, where given, ``max_size`` (bytes) and ``cap`` (files
    per language) act on the file statistics; the search reads all files of the project's languages, or only the kept
    ones with ``search_scope='kept'``. Files count for the languages of their suffix, so a file may count twice or not
    at all. Directories and packages that show a user interface are looked for in the whole tree. ``chars`` limits the
    characters that languages are detected from.
    """
    ready = E.with_entries(files, None, exclude, include, max_size, languages, search_scope, chars)
    results = E.language_results(E.project_entries(E.searched_entries(ready, rules, None, cap)), None, languages)
    scores = score_projects(results, compat=compat)
    return Scan(results, scores.select(*SCORE_COLUMNS), summarize(scores))
