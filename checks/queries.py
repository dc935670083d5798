"""The registered queries: one per operator, over the given tables.

Results are brought to plain column types: whole numbers as bigint, other numbers as doubles rounded to
six digits, lists as text joined with " | ".
"""

from pyspark.sql import DataFrame, functions as F, types as T

from checks import corpora as C
from portcullis.dims import gates as D, technologies as TD
from portcullis.dims.languages import LANGUAGE_ORD
from portcullis.dims.rules import default_rules
from portcullis.functions.tables import shared
from portcullis.functions.text import lookup
from portcullis.operators import (
    details as DE, filters as P, gates as G, joins as J, languages as L, matching as M, reports as R, samples as X, scoring as A,
    technology as TE,
)
from portcullis.plans import scan as SC
from portcullis.sources import files as S, report_files as RF
from portcullis.streaming import scan as ST

QUERIES = {}


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c, " | ")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# Plans over the code corpus are large; a session builds each of them once. They hold no data.
_plans = {}


def _once(spark, sf_dir, name, make):
    key = (id(spark), sf_dir, name)
    if key not in _plans:
        _plans[key] = make()
    return _plans[key]


def lines(spark, sf):
    return _once(spark, sf, "lines", lambda: C.code_lines(spark, sf))


def hits(spark, sf, *gates):
    """Hits with keys, gate and text; for all gates or some."""
    rules = default_rules(list(gates)) if gates else None
    return _once(spark, sf, ("hits", gates), lambda: M.match_gates(lines(spark, sf), rules))


def described(spark, sf, *gates):
    rules = default_rules(list(gates)) if gates else None
    return _once(spark, sf, ("described", gates), lambda: M.describe(M.match_lines(lines(spark, sf), rules)))


def full(spark, sf):
    return _once(spark, sf, "full", lambda: M.full_matches(lines(spark, sf), context=False))


def scan(spark, sf):
    return _once(spark, sf, "scan", lambda: SC.scan_lines(lines(spark, sf)))


def scan_for_several(spark, sf):
    """The scan for queries that use more than one of its tables."""
    return _once(spark, sf, "scan for several", lambda: SC.scan_lines(lines(spark, sf), shared=True))


def results(spark, sf):
    return scan(spark, sf).results


def scores(spark, sf):
    return scan(spark, sf).scores


def combined(spark, sf):
    return A.combine_languages(results(spark, sf)).select(*COMBINED)


def detailed(spark, sf):
    """Scores with their details and recommendations."""
    def make():
        sc = SC.scan_lines(lines(spark, sf), shared=True)
        return DE.gate_details(sc.scores, sc.results, hits(spark, sf), TE.detect_technologies(lines(spark, sf), "line"))

    return _once(spark, sf, "detailed", make)


COMBINED = ["project_id", "gate", "expected", "found", "quality_score"]
KEY = ["project_id", "path", "line_no", "rule_id"]

# ---------------------------------------------------------------- sources and sinks


def tree_scan(spark, sf):
    """The scan of all trees and texts as files."""
    names = ["project_id", "path", "file_name", "ext", "size", "content"]
    files = C.tree_files(spark, sf).select(*names).unionByName(C.text_files(spark, sf).select(*names))
    return _once(spark, sf, "tree scan", lambda: SC.scan_files(files))


@query
def s1_scan_scores(spark, sf):
    return tree_scan(spark, sf).scores.drop("gate_ord")


@query
def s1_scan_summary(spark, sf):
    return tree_scan(spark, sf).summary


@query
def s2_files_from_table(spark, sf):
    return C.text_files(spark, sf).select("project_id", "path", "file_name", "ext", "size", "language")


@query
def s3_explode_lines(spark, sf):
    return S.explode_lines(C.text_files(spark, sf), ("project_id", "path"))


@query
def s4_json_reports(spark, sf):
    sc = scan(spark, sf)
    gates = R.report_gates(detailed(spark, sf))
    reports = RF.json_reports(sc.summary, gates, R.report_summary(gates), A.project_findings(sc.scores), "2024-01-01 00:00:00")
    one = reports.withColumn("first_gate", F.element_at("gates", 1)).withColumn("gate_count", F.size("gates"))
    return one.select(
        "project_name", "language", "scan_date", "overall_score", "total_files", "total_lines", "gate_summary.total_gates",
        "gate_summary.partial_gates", "gate_count", F.col("first_gate.name").alias("first_name"),
        F.col("first_gate.score").alias("first_score"), F.array_join("first_gate.details", " | ").alias("first_details"), "critical_issues", "recommendations",
    )


@query
def s5_sarif_results(spark, sf):
    return RF.sarif_results(full(spark, sf))


@query
def s6_latest_reports(spark, sf):
    events = C.table(spark, sf, "events")
    reports = events.select(
        F.concat(F.lit("proj"), (F.col("user_id") % 8).cast("string")).alias("project_name"),
        F.concat(F.lit("report_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".json")).alias("file_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("scan_date"),
        F.col("value").alias("overall_score"),
    )
    per_file = reports.groupBy("project_name", "file_name", "scan_date").agg(F.max("overall_score").alias("overall_score"))
    return RF.latest_reports(per_file)


@query
def s7_manifest_files(spark, sf):
    return S.manifest_files(C.tree_files(spark, sf))


# ---------------------------------------------------------------- file filters

PATHS = ["project_id", "path", "size"]


@query
def p1_exclude_paths(spark, sf):
    return P.exclude_paths(C.tree_files(spark, sf), ["node_modules", "*.css", "docs/*/README.md"]).select(*PATHS)


@query
def p2_include_paths(spark, sf):
    return P.include_paths(C.tree_files(spark, sf), ["*.py", "*.java", "Dockerfile", "run.*"]).select(*PATHS)


@query
def p3_max_file_size(spark, sf):
    return P.max_file_size(C.tree_files(spark, sf)).select(*PATHS)


@query
def p4_prune_dirs(spark, sf):
    return P.prune_dirs(C.tree_files(spark, sf)).select(*PATHS)


@query
def p5_file_columns(spark, sf):
    files = C.tree_files(spark, sf)
    return files.select("project_id", "path", "file_name", "ext", F.lower("ext").alias("ext_lower"))


def addresses(spark, sf):
    customers = C.table(spark, sf, "customer")
    made = customers.selectExpr(
        "c_custkey AS id",
        """CASE CAST(c_custkey % 6 AS INT)
             WHEN 0 THEN concat('https://github.com/owner', c_custkey, '/repo', c_custkey)
             WHEN 1 THEN concat('https://github.com/owner', c_custkey, '/repo.git')
             WHEN 2 THEN concat('https://code.GitHub.corp', c_nationkey, '.com/team/project.git/')
             WHEN 3 THEN 'https://gitlab.com/user/repo'
             WHEN 4 THEN concat('https://github.com/solo', c_custkey)
             ELSE 'https://github.com/a/b/tree/main?x=1#top' END AS url""",
    )
    pages = C.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    return made.unionByName(pages)


@query
def p6_project_name(spark, sf):
    return addresses(spark, sf).select(
        "id", "url", P.project_name("url", F.lit("local")).alias("project_name"), P.report_project_name("url").alias("report_name")
    )


@query
def p7_classify_repo_url(spark, sf):
    return P.classify_repo_url(addresses(spark, sf))


@query
def p8_high_priority_matches(spark, sf):
    return P.high_priority_matches(full(spark, sf)).select(*KEY, "priority", "severity", "matched_text")


@query
def p9_applicable_gates(spark, sf):
    return P.applicable_gates(scores(spark, sf)).select("project_id", "gate", "status", "final_score")


# ---------------------------------------------------------------- languages


def classified(spark, sf):
    return L.file_language(C.tree_files(spark, sf).drop("language"))


def language_stats(spark, sf):
    kept = P.max_file_size(P.prune_dirs(classified(spark, sf)))
    return L.language_statistics(kept)


@query
def l1_file_language(spark, sf):
    files = C.tree_files(spark, sf).select("project_id", "path", "ext", "content")
    texts = C.text_files(spark, sf).select("project_id", "path", "ext", "content")
    return L.file_language(files.unionByName(texts)).select("project_id", "path", "language")


@query
def l2_content_score(spark, sf):
    return L.content_score_of_lines(lines(spark, sf))


@query
def l3_extension_histogram(spark, sf):
    return L.extension_histogram(C.tree_files(spark, sf))


@query
def l4_config_presence(spark, sf):
    return L.config_presence(C.tree_files(spark, sf))


@query
def l5_language_confidence(spark, sf):
    signs = L.signs_of_lines(lines(spark, sf)).groupBy("project_id", "language").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("content_matches").alias("content_matches")
    )
    names = C.code_files(spark, sf).select("project_id", "file_name").unionByName(C.tree_files(spark, sf).select("project_id", "file_name"))
    known = signs.join(L.config_presence(names), ["project_id", "language"], "left").withColumn("has_config", F.coalesce("has_config", F.lit(False)))
    return known.withColumn("confidence", L.confidence()).drop("has_config")


@query
def l6_language_statistics(spark, sf):
    return language_stats(spark, sf)


@query
def l7_detect_languages(spark, sf):
    return L.detect_languages(language_stats(spark, sf)).select("project_id", "language", "confidence")


@query
def l8_primary_language(spark, sf):
    projects = C.tree_files(spark, sf).select("project_id").distinct()
    return L.primary_language(projects, L.detect_languages(language_stats(spark, sf)))


# ---------------------------------------------------------------- matching


@query
def m1_match_lines(spark, sf):
    return M.match_lines(lines(spark, sf)).select(*KEY, "gate", "language")


@query
def m2_positions(spark, sf):
    return M.with_positions(M.match_lines(lines(spark, sf))).select(*KEY, "matched_text", "column_start", "column_end")


@query
def m3_line_shape(spark, sf):
    return M.with_line_shape(M.match_lines(lines(spark, sf))).select(*KEY, "full_line", "line_length", "indentation_level")


@query
def m4_is_comment(spark, sf):
    return M.with_line_shape(M.match_lines(lines(spark, sf))).select(*KEY, "is_comment")


@query
def m5_is_string_literal(spark, sf):
    return described(spark, sf).select(*KEY, "is_string_literal")


@query
def m6_severity(spark, sf):
    return described(spark, sf).select(*KEY, "severity")


@query
def m7_pattern_type(spark, sf):
    return described(spark, sf).select(*KEY, "pattern_type")


@query
def m8_category(spark, sf):
    return described(spark, sf).select(*KEY, "category")


@query
def m9_suggested_fix(spark, sf):
    return described(spark, sf).select(*KEY, "suggested_fix")


@query
def m10_documentation_link(spark, sf):
    return described(spark, sf).select(*KEY, "documentation_link")


@query
def m11_function_context(spark, sf):
    src = lines(spark, sf)
    return M.with_function(src.select("project_id", "path", "line_no"), src)


@query
def m12_hit_context(spark, sf):
    """The lines around every hit: only these are gathered."""
    found = M.context_of(hits(spark, sf).select("project_id", "path", "line_no").distinct(), lines(spark, sf))
    return found.select("project_id", "path", "line_no", "context_lines", "context_start_line", "context_end_line")


@query
def m11_function_anywhere(spark, sf):
    """The nearest header of every hit, however far back."""
    asked = hits(spark, sf).select("project_id", "path", "line_no").distinct()
    return M.with_function(asked, lines(spark, sf), None)


@query
def m12_context_lines(spark, sf):
    return M.with_context_lines(lines(spark, sf)).select(
        "project_id", "path", "line_no", "context_lines", "context_start_line", "context_end_line"
    )


@query
def m13_priority(spark, sf):
    return full(spark, sf).select(*KEY, "function_name", "priority")


@query
def m14_match_summary(spark, sf):
    return M.match_summary(full(spark, sf))


# ---------------------------------------------------------------- joins


@query
def j1_lines_rules(spark, sf):
    return J.j1_lines_rules(lines(spark, sf), J.guarded_rules(spark)).select(*KEY, "gate")


@query
def j2_language_rules(spark, sf):
    languages = C.tree_files(spark, sf).where("language IS NOT NULL").select("project_id", "language").distinct()
    return J.j2_language_rules(languages).select("project_id", "gate", "language", "rules")


@query
def j3_every_gate(spark, sf):
    projects = C.tree_files(spark, sf).select("project_id").unionByName(C.code_files(spark, sf).select("project_id")).distinct()
    found = hits(spark, sf).groupBy("project_id", "gate").agg(F.count(F.lit(1)).alias("found"))
    return J.j3_every_gate(projects, found).select("project_id", "gate", F.coalesce("found", F.lit(0)).alias("found"))


@query
def j4_language_filter(spark, sf):
    detected = L.detect_languages(language_stats(spark, sf))
    return J.j4_language_filter(classified(spark, sf), detected).select("project_id", "path", "language")


@query
def j5_gate_facts(spark, sf):
    return J.j5_gate_facts(combined(spark, sf)).select("project_id", "gate", "found", "weight", "gate_category", "display_name")


def comments(spark, sf):
    labels = C.table(spark, sf, "labels").select(
        F.concat(F.lit("proj"), (F.col("doc_id") % 8).cast("string")).alias("project_id"),
        F.element_at(F.array(*[F.lit(g) for g in D.GATES]), (F.floor(F.col("doc_id") / 8) % 15 + 1).cast("int")).alias("gate"),
        "quality", "toxic",
    )
    supplied = labels.groupBy("project_id", "gate").agg(F.concat(F.lit("quality "), F.min("quality").cast("string")).alias("comment"))
    stored = labels.where("toxic = 1").groupBy("project_id", "gate").agg(
        F.concat(F.lit("toxic "), F.count(F.lit(1)).cast("string")).alias("comment")
    )
    return supplied, stored


@query
def j6_comments(spark, sf):
    supplied, stored = comments(spark, sf)
    return J.j6_comments(combined(spark, sf).select("project_id", "gate"), supplied, stored)


def saved_reports(spark, sf):
    """Saved report files templated from all ``events``."""
    return C.table(spark, sf, "events").groupBy("user_id").agg(
        (F.count(F.lit(1)) * 40_000).alias("size"), F.max("ts").alias("modified")
    ).select(
        F.concat(F.lit("hard_gate_report_"), F.col("user_id").cast("string"), F.lit(".html")).alias("file_name"), "size", "modified"
    )


def runs(spark, sf):
    """Scan states templated from all ``events``."""
    states = C.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("scan_id"), F.col("event_type").alias("status"), "ts", "value"
    )
    return states.groupBy("scan_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("value").alias("score")
    )


@query
def j7_report_runs(spark, sf):
    saved = saved_reports(spark, sf).withColumn("scan_id", R.scan_id())
    return J.j7_report_runs(saved, runs(spark, sf)).select("scan_id", "file_name", "status")


@query
def j8_nearest_header(spark, sf):
    src = lines(spark, sf)
    asked = hits(spark, sf).select("project_id", "path", "line_no", "rule_no", "matched_text").drop("rule_no")
    return J.j8_nearest_header(asked, src)


@query
def j9_without_language(spark, sf):
    files = C.tree_files(spark, sf).select("project_id", "path", "ext", "content").unionByName(
        C.text_files(spark, sf).select("project_id", "path", "ext", "content")
    )
    return J.j9_without_language(files, L.file_language(files)).select("project_id", "path")


# ---------------------------------------------------------------- gates


def _gate_query(number, gate):
    def run(spark, sf):
        return G.gate_result(lines(spark, sf), hits(spark, sf, gate), gate).drop("bonus")

    run.__name__ = f"g{number}_{gate}"
    query(run)


GATE_NUMBERS = (
    "structured_logs avoid_logging_secrets audit_trail correlation_id log_api_calls log_background_jobs ui_errors "
    "retry_logic timeouts throttling circuit_breakers error_logs http_codes ui_error_tools automated_tests"
).split()
for _i, _gate in enumerate(GATE_NUMBERS, 1):
    _gate_query(_i, _gate)


@query
def g16_quality_score(spark, sf):
    return results(spark, sf).select("project_id", "gate", "language", "found", "expected", "bonus", "quality")


@query
def g17_violation_breakdown(spark, sf):
    return G.violation_breakdown(hits(spark, sf, D.SECRETS_GATE))


@query
def g18_violation_severity(spark, sf):
    return G.violation_severity(hits(spark, sf, D.SECRETS_GATE))


@query
def g19_violation_examples(spark, sf):
    return G.violation_examples(hits(spark, sf, D.SECRETS_GATE)).select(
        "project_id", "example_no", "violation_kind", "path", "line_no", F.substring("matched_text", 1, 60).alias("shown")
    )


@query
def g20_gate_kinds(spark, sf):
    return G.gate_kinds(hits(spark, sf))


@query
def g21_http_status_codes(spark, sf):
    return G.http_status_codes(hits(spark, sf, "http_codes"))


@query
def g22_files_per_gate(spark, sf):
    return G.files_per_gate(hits(spark, sf))


@query
def g23_longest_matches(spark, sf):
    return G.longest_matches(hits(spark, sf)).select("project_id", "gate", "rank", "match_length", "path", "line_no", "matched_text")


@query
def g24_request_response_counts(spark, sf):
    return G.request_response_counts(hits(spark, sf, "log_api_calls"))


@query
def g25_tools_detected(spark, sf):
    return G.tools_detected(hits(spark, sf, "ui_error_tools"))


@query
def g26_recommendation_bucket(spark, sf):
    return G.recommendations(results(spark, sf)).select("project_id", "gate", "language", "bucket", "position", "advice")


# ---------------------------------------------------------------- technologies


def code_and_tree(spark, sf):
    """Tree files as one text each, code lines as one text per line."""
    tree = C.tree_files(spark, sf).where("language IS NOT NULL").select("project_id", "path", "language", "content")
    code = lines(spark, sf).select("project_id", "path", "language", F.col("line").alias("content"))
    return tree.unionByName(code)


@query
def t1_detect_technologies(spark, sf):
    return TE.detect_technologies(code_and_tree(spark, sf))


@query
def t2_technologies_in_manifests(spark, sf):
    tree = C.tree_files(spark, sf)
    code = TE.detect_technologies(tree.where("language IS NOT NULL"))
    languages = tree.where("language IS NOT NULL").select("project_id", "language").distinct()
    return TE.technologies_in_manifests(tree, languages, code)


@query
def t3_sample_technologies(spark, sf):
    tree = TE.sample_technologies(C.tree_files(spark, sf).where("language IS NOT NULL"))
    return tree.unionByName(TE.sample_technologies_of_lines(lines(spark, sf)))


@query
def t4_has_ui_components(spark, sf):
    files = C.tree_files(spark, sf).unionByName(C.text_files(spark, sf))
    return TE.has_ui_components(files)


@query
def t5_has_background_jobs(spark, sf):
    files = C.tree_files(spark, sf).unionByName(C.text_files(spark, sf))
    return TE.has_background_jobs(files)


@query
def t6_gate_applicability(spark, sf):
    files = C.tree_files(spark, sf)
    return TE.gate_applicability(TE.has_ui_components(files), TE.has_background_jobs(files))


@query
def t7_tech_stack(spark, sf):
    return TE.tech_stack(L.detect_languages(language_stats(spark, sf)))


# ---------------------------------------------------------------- scoring


@query
def a1_file_analyses(spark, sf):
    texts = G.file_analyses_of_files(C.text_files(spark, sf).withColumn("language", F.lit("text")))
    return G.file_analyses(lines(spark, sf)).unionByName(texts)


@query
def a2_totals(spark, sf):
    return A.totals(G.file_analyses(lines(spark, sf)))


@query
def a3_combine_languages(spark, sf):
    return combined(spark, sf)


@query
def a3_combine_languages_compat(spark, sf):
    return A.combine_languages(results(spark, sf), compat=True).select(*COMBINED)


@query
def a3_gate_details(spark, sf):
    return detailed(spark, sf).select("project_id", "gate", "details", "recommendations")


@query
def a4_coverage(spark, sf):
    return combined(spark, sf).select("project_id", "gate", A.coverage().alias("coverage"))


@query
def a5_quality_multiplier(spark, sf):
    return combined(spark, sf).select("project_id", "gate", "quality_score", A.quality_multiplier().alias("multiplier"))


@query
def a6_gate_score(spark, sf):
    scored = combined(spark, sf).withColumn("coverage", A.coverage())
    return scored.select("project_id", "gate", "coverage", "quality_score", A.final_score().alias("final_score"))


@query
def a7_score_breakdown(spark, sf):
    return A.score_breakdown(combined(spark, sf).withColumn("coverage", A.coverage()))


@query
def a8_gate_status(spark, sf):
    return scores(spark, sf)


@query
def a9_gate_priority_tier(spark, sf):
    return combined(spark, sf).select("project_id", "gate", G.gate_tier().alias("tier"))


@query
def a10_summary_counts(spark, sf):
    return A.summary_counts(scores(spark, sf))


@query
def a11_overall_score(spark, sf):
    return A.overall_score(scores(spark, sf))


@query
def a12_mean_all_gates(spark, sf):
    return A.mean_all_gates(scores(spark, sf))


@query
def a13_weighted_overall(spark, sf):
    return A.weighted_overall(scores(spark, sf))


@query
def a14_critical_issues(spark, sf):
    return A.project_findings(scores(spark, sf))


@query
def a15_threshold_verdict(spark, sf):
    return A.threshold_verdict(A.overall_score(scores(spark, sf)))


@query
def a16_distributions(spark, sf):
    return A.distributions(described(spark, sf))


@query
def a17_coverage_stats(spark, sf):
    return A.coverage_stats(full(spark, sf))


@query
def a18_basic_project_score(spark, sf):
    return A.basic_project_score(C.tree_files(spark, sf))


@query
def a19_feasibility(spark, sf):
    reports = C.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(
            F.col("o_orderstatus") == "O", F.concat(F.lit("<p>Migration_Score: "), (F.floor(F.col("o_totalprice")) % 101).cast("string"), F.lit("</p>"))
        ).when(F.col("o_orderstatus") == "F", "no number: migration_score").otherwise("score: 99").alias("text"),
    )
    return A.feasibility(reports).drop("text")


# ---------------------------------------------------------------- windows, top-k, set operations


@query
def w1_first_files(spark, sf):
    files = C.tree_files(spark, sf)
    return L.first_files(files.where("language IS NOT NULL"), 20).select("project_id", "language", "path")


@query
def w2_shown_hits(spark, sf):
    return G.shown_hits(hits(spark, sf)).select("project_id", "gate", "path", "hit_no", "file_hit_no", "line_no", "shown_text", "more")


@query
def w3_context(spark, sf):
    src = lines(spark, sf)
    wide = M.with_context_lines(src)
    return M.with_function(wide.select("project_id", "path", "line_no", "context_start_line", "context_end_line"), src)


@query
def w4_newest_first(spark, sf):
    return R.newest_first(saved_reports(spark, sf), "modified", "file_name")


@query
def w5_truncations(spark, sf):
    texts = G.recommendations(results(spark, sf)).groupBy("project_id", "gate").agg(
        F.sort_array(F.collect_set("advice")).alias("advice")
    )
    return texts.select("project_id", "gate", R.truncated("advice").alias("first_five"), F.size("advice").alias("n"))


@query
def w6_score_trend(spark, sf):
    reports = C.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("project_id"), F.col("event_id").alias("scan_id"), F.col("ts").alias("scan_ts"), F.col("value").alias("score")
    )
    return R.score_trend(reports, block_days=1).select("project_id", "scan_id", "score", "previous_score", "change")


@query
def u1_union_hits(spark, sf):
    """Hits of all gates together; one search gives their union."""
    return hits(spark, sf).groupBy("project_id", "gate", "language").agg(F.count(F.lit(1)).alias("hits"))


@query
def u2_distinct_recommendations(spark, sf):
    """The advice of all languages of a project's gate in language order, without repeats."""
    texts = G.recommendations(results(spark, sf)).groupBy("project_id", "gate").agg(
        F.sort_array(F.collect_list(F.struct(lookup("language", LANGUAGE_ORD).alias("o"), "position", "advice"))).alias("_all")
    )
    listed = texts.withColumn("recommendations", F.transform("_all", lambda x: x["advice"]))
    return listed.select("project_id", "gate", R.distinct_recommendations().alias("recommendations"))


@query
def u3_distinct_tools(spark, sf):
    tools = G.tools_detected(hits(spark, sf, "ui_error_tools")).select(F.lit("tool").alias("kind"), F.col("tool").alias("name"))
    codes = G.http_status_codes(hits(spark, sf, "http_codes")).select(F.lit("code").alias("kind"), F.explode("codes").alias("name"))
    techs = TE.detect_technologies(code_and_tree(spark, sf)).select(F.lit("technology").alias("kind"), F.col("technology").alias("name"))
    return tools.unionByName(codes).unionByName(techs).distinct()


# ---------------------------------------------------------------- reports


@query
def r1_report_gates(spark, sf):
    return R.report_gates(scores(spark, sf)).select("project_id", "gate", "status", "final_score")


@query
def r2_report_summary(spark, sf):
    return R.report_summary(R.report_gates(scores(spark, sf)))


@query
def r3_secrets_status(spark, sf):
    return R.secrets_status(R.report_gates(scores(spark, sf)))


@query
def r4_report_rows(spark, sf):
    return R.report_rows(R.report_gates(scores(spark, sf)), comments(spark, sf)[0])


@query
def r5_issue_comment(spark, sf):
    sc = scan_for_several(spark, sf)
    text = R.issue_comment(sc.summary, sc.scores, A.project_findings(sc.scores), "2024-01-01 00:00:00", "text")
    return text


@query
def r5_issue_comment_markdown(spark, sf):
    sc = scan_for_several(spark, sf)
    return R.issue_comment(sc.summary, sc.scores, A.project_findings(sc.scores), "2024-01-01 00:00:00")


@query
def r6_report_listing(spark, sf):
    return R.report_listing(saved_reports(spark, sf), runs(spark, sf))


@query
def r7_expired_reports(spark, sf):
    return R.expired_reports(saved_reports(spark, sf), 2, "2024-02-01 12:00:00").select("file_name", "modified")


@query
def r8_comments_hash(spark, sf):
    supplied, _ = comments(spark, sf)
    maps = supplied.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("gate", "comment"))).alias("comments"))
    return maps.select("project_id", R.comments_hash().alias("comments_hash"))


def issue_table(spark, sf):
    # One search serves the scores and the issues.
    hits = shared(M.search_lines(lines(spark, sf)), *M.LINE_KEYS)
    found = M.describe(M.with_rules(hits))
    listed = found.select("project_id", "gate", "path", "line_no", F.col("column_start").alias("column_no"), F.col("matched_text").alias("message"))
    return R.issues(SC.scan_lines(lines(spark, sf), hits=M.with_gates(hits)).scores, listed)


@query
def r9_issues(spark, sf):
    return R.issue_counts(issue_table(spark, sf))


@query
def r10_gates_by_tier(spark, sf):
    return R.gates_by_tier(scores(spark, sf))


@query
def r11_compliance(spark, sf):
    sc = scan_for_several(spark, sf)
    return R.compliance(sc.scores.join(sc.summary.select("project_id", "overall_score"), "project_id"))


@query
def r12_recommendation_rows(spark, sf):
    return R.recommendation_rows(G.recommendations(results(spark, sf)).select("project_id", "gate", "language", "position", "advice"))


@query
def r13_diagnostics(spark, sf):
    return R.diagnostics(issue_table(spark, sf))


@query
def r14_format_gate_name(spark, sf):
    named = C.table(spark, sf, "events").select("event_type").distinct().select(F.concat("event_type", F.lit("_rate_limit")).alias("gate"))
    gates = combined(spark, sf).select("gate").distinct()
    return gates.unionByName(named).select("gate", R.display_name().alias("display_name"), R.title_words("gate").alias("view_name"))


@query
def r15_component_declarations(spark, sf):
    components = C.table(spark, sf, "supplier").select(
        F.col("s_name").alias("component_name"),
        F.when(F.col("s_acctbal") > 5000, "High").alias("business_criticality"),
        F.when(F.col("s_nationkey") > 12, F.lit("cloud")).otherwise("").alias("current_environment"),
        F.lit(None).cast("string").alias("application_type"),
        F.create_map(F.lit("database"), F.col("s_acctbal") > 0, F.lit("cache"), F.col("s_nationkey") > 5).alias("component_declarations"),
    )
    return R.component_declarations(components)


@query
def r16_api_gates(spark, sf):
    return R.api_gates(detailed(spark, sf)).select("project_id", "gate", "status", "details")


# ---------------------------------------------------------------- scoring model


def samples(spark, sf):
    return X.code_samples(described(spark, sf))


@query
def x1_code_samples(spark, sf):
    return samples(spark, sf)


@query
def x2_relevant_samples(spark, sf):
    return X.relevant_samples(samples(spark, sf))


def document_samples(spark, sf):
    """Long samples: documents as the samples of their source."""
    return C.table(spark, sf, "documents").select(
        F.col("source").alias("project_id"), F.lit("error_logs").alias("gate"), F.col("doc_id").alias("position"), F.col("text").alias("sample")
    )


@query
def x3_budget_samples(spark, sf):
    return X.budget_samples(document_samples(spark, sf))


@query
def x4_gate_prompts(spark, sf):
    # One search serves the counts, the samples and the results.
    told = ["language", "rule_no", "gate", "matched_text", "full_line", "pattern_type", "severity", "category", "function_name"]
    hits = shared(full(spark, sf).select(*M.LINE_KEYS, *told), *M.LINE_KEYS)
    found = SC.scan_lines(lines(spark, sf), hits=hits).results
    return X.gate_prompts(X.prompt_context(hits, found)).select("project_id", "gate", "prompt")


@query
def x5_parse_model_response(spark, sf):
    return X.parse_model_response(C.model_answers(spark, sf)).select("event_id", "quality_score", "recommendations")


@query
def x6_parse_recommendations(spark, sf):
    made = C.model_answers(spark, sf).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), "text")
    turns = C.table(spark, sf, "conversations").where("role = 'assistant'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text"
    )
    return made.unionByName(turns).select("id", X.parse_recommendations().alias("recommendations"), X.parse_recommendations(longer_than=10).alias("base_recommendations"))


@query
def x7_fallback_quality(spark, sf):
    return X.fallback_quality(described(spark, sf))


@query
def x7_simple_fallback(spark, sf):
    return X.simple_fallback(samples(spark, sf))


@query
def x8_gate_batch_order(spark, sf):
    return X.gate_batch_order(combined(spark, sf).select("project_id", "gate"))


@query
def x9_apply_enhancement(spark, sf):
    events = X.parse_model_response(C.model_answers(spark, sf).withColumn("gate_no", F.col("event_id") % 15))
    enhanced = events.groupBy(
        F.concat(F.lit("proj"), (F.col("event_id") % 8).cast("string")).alias("project_id"),
        F.element_at(F.array(*[F.lit(g) for g in D.GATES]), (F.col("gate_no") + 1).cast("int")).alias("gate"),
    ).agg(
        F.max("quality_score").alias("quality_score"),
        F.max_by("recommendations", "event_id").alias("recommendations"),
        F.array(F.concat(F.lit("answers: "), F.count(F.lit(1)).cast("string"))).alias("security_issues"),
    )
    return X.apply_enhancement(detailed(spark, sf), enhanced).select("project_id", "gate", "quality_score", "final_score", "recommendations", "insights")


def _length_model(prompts):
    """Stands in for a model: a fixed function of the prompt."""
    return [f'{{"quality_score": {len(p) % 101}}}' for p in prompts]


@query
def x10_score_with(spark, sf):
    prompts = samples(spark, sf).select("project_id", "gate", F.col("sample").alias("prompt"))
    answers = X.score_with(prompts, _length_model)
    return X.parse_model_response(answers, "answer").groupBy("project_id", "gate").agg(F.avg("quality_score").alias("quality_score"))


# ---------------------------------------------------------------- streams, functions


@query
def st1_stream_matches(spark, sf):
    """The described hits that the stream form gives, computed on the table."""
    return ST.stream_matches(lines(spark, sf)).select(*KEY, "column_start", "severity", "category", "priority")


@query
def st2_scan_status_latest(spark, sf):
    states = C.table(spark, sf, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("status"), "ts")
    return ST.scan_status_latest(states)


@query
def udtf_scan_text(spark, sf):
    from portcullis.functions.udtf import register

    register(spark)
    return spark.sql(
        "SELECT l.project_id, l.path, l.line_no, s.rule_id, s.gate, s.matched_text, s.column_start, s.column_end "
        "FROM {l} l, LATERAL scan_text(l.line, l.language) s",
        l=lines(spark, sf),
    )
