"""Report tables: what a report or an editor view shows, as rows."""

from pyspark.sql import DataFrame, functions as F

from ..dims import gates as D
from ..functions.ranking import with_previous
from ..functions.text import bands, col, fixed1, lookup, title_words
from .gates import gate_weight


def view_status(score="final_score"):
    return bands(score, [(80, "PASS"), (60, "WARNING")], "FAIL")


def report_gates(scores: DataFrame) -> DataFrame:
    """The report's own status; one that is not a final word is derived from the score."""
    s = F.col("status")
    status = (
        F.when(s == "PASSED", "PASS")
        .when(s == "FAILED", "FAIL")
        .when(s.isin("WARNING", "NOT_APPLICABLE"), s)
        .otherwise(view_status())
    )
    return scores.withColumn("status", status)


def report_summary(gates: DataFrame) -> DataFrame:
    """Implemented, partial and missing gates. A passed gate with hits counts as partial."""
    s, n, secrets = F.col("status"), F.col("found"), F.col("gate") == D.SECRETS_GATE
    kind = (
        F.when((n > 0) & secrets, "missing")
        .when((n > 0) & (s == "PASS"), "partial")
        .when(s == "PASS", "implemented")
        .when(s == "WARNING", "partial")
        .otherwise("missing")
    )
    return gates.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_gates"),
        F.count_if(kind == "implemented").alias("implemented_gates"),
        F.count_if(kind == "partial").alias("partial_gates"),
        F.count_if(kind == "missing").alias("not_implemented_gates"),
    )


def secrets_status(gates: DataFrame) -> DataFrame:
    """What the report says about confidential data, also for projects without that gate."""
    secrets = F.col("gate") == D.SECRETS_GATE
    one = gates.groupBy("project_id").agg(
        F.max(F.when(secrets, F.col("found"))).alias("_n"), F.bool_or(secrets & (F.col("status") == "PASS")).alias("_ok")
    )
    leak, ok = F.coalesce(F.col("_n") > 0, F.lit(False)), F.col("_ok")
    return one.select(
        "project_id",
        F.when(leak, "warning").when(ok, "safe").otherwise("unknown").alias("secrets_status"),
        F.when(leak, F.format_string("Found %d potential confidential data logging violations", "_n"))
        .when(ok, "No secrets or confidential data detected")
        .otherwise("Secrets analysis not available")
        .alias("message"),
    )


def display_name(gate="gate"):
    return F.coalesce(lookup(gate, D.DISPLAY_NAMES), title_words(gate))


def report_rows(gates: DataFrame, comments: DataFrame = None) -> DataFrame:
    """The rows of the report table: category, practice, status, evidence, recommendation and comment."""
    s, n = F.col("status"), F.col("found")
    leak = (n > 0) & (F.col("gate") == D.SECRETS_GATE)
    issues = (n > 0) & (s == "PASS")
    low = F.lower(display_name())
    rows = gates.select(
        "project_id",
        "gate",
        lookup("gate", D.CATEGORY_OF).alias("gate_category"),
        display_name().alias("practice"),
        F.when(leak, "✗ Violations Found")
        .when(issues, "⚬ Has Issues")
        .when(s == "PASS", "✓ Implemented")
        .when(s == "WARNING", "⚬ Partial")
        .when(s == "NOT_APPLICABLE", "N/A")
        .otherwise("✗ Missing")
        .alias("status_text"),
        F.when(s == "NOT_APPLICABLE", "Not applicable to this project type")
        .when(n > 0, F.concat(F.lit("Found "), n.cast("string"), F.lit(" implementations with "), fixed1("coverage"), F.lit("% coverage")))
        .otherwise("No relevant patterns found in codebase")
        .alias("evidence"),
        F.when(leak, F.concat(F.lit("Fix confidential data logging violations in "), low))
        .when(issues, F.concat(F.lit("Address identified issues in "), low))
        .when(s == "PASS", "Continue maintaining good practices")
        .when(s == "WARNING", F.concat(F.lit("Expand implementation of "), low))
        .when(s == "NOT_APPLICABLE", "Not applicable to this project type")
        .otherwise(F.concat(F.lit("Implement "), low))
        .alias("recommendation"),
    )
    if comments is None:
        return rows.withColumn("comment", F.lit(""))
    return with_comments(rows, comments).withColumn("comment", F.coalesce("comment", F.lit("")))


def with_comments(gates: DataFrame, supplied: DataFrame, stored: DataFrame = None) -> DataFrame:
    """Comments by gate; a stored comment replaces a supplied one."""
    out = gates.join(supplied.select("project_id", "gate", F.col("comment").alias("_given")), ["project_id", "gate"], "left")
    if stored is None:
        return out.withColumnRenamed("_given", "comment")
    kept = stored.select("project_id", "gate", F.col("comment").alias("_kept"))
    return out.join(kept, ["project_id", "gate"], "left").withColumn("comment", F.coalesce("_kept", "_given")).drop("_kept", "_given")


def compliance_band(score="overall_score"):
    return bands(score, [(80, "HIGH"), (60, "MODERATE")], "LOW")


COMPLIANCE_TEXT = {
    "HIGH": "🟢 **HIGH COMPLIANCE** - Excellent gate coverage",
    "MODERATE": "🟡 **MODERATE COMPLIANCE** - Some improvements needed",
    "LOW": "🔴 **LOW COMPLIANCE** - Significant improvements required",
}
STATUS_SIGNS = {"PASS": "✅", "WARNING": "⚠️", "FAIL": "❌", "FAILED": "❌", "NOT_APPLICABLE": "🚫"}


def _numbered(texts, first):
    kept = F.slice(F.col(texts), 1, first)
    return F.array_join(F.transform(kept, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def issue_comment(summary: DataFrame, gates: DataFrame, findings: DataFrame, generated: str, style="markdown") -> DataFrame:
    """The text posted to an issue, one per project. A project has at most 15 gates, so texts stay small."""
    category_ord = lookup("gate", {g: i for i, c in enumerate(D.CATEGORIES) for g in D.CATEGORIES[c]})
    row = F.concat(
        F.lit("| "), title_words("gate"), F.lit(" | "), lookup("status", STATUS_SIGNS, "❓"), F.lit(" "), F.col("status"),
        F.lit(" | "), fixed1("final_score"), F.lit("% | "), fixed1("coverage"), F.lit("% |"),
    )
    shown = gates.withColumn("_c", category_ord).withColumn("_o", lookup("gate", D.GATE_ORD)).withColumn("_row", row)
    by_category = shown.groupBy("project_id", "_c").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_o", "_row"))), lambda x: x["_row"]), "\n"
        ).alias("_rows")
    )
    names = F.element_at(F.array(*[F.lit(c) for c in D.CATEGORIES]), F.col("_c") + 1)
    table = F.concat(
        F.lit("#### "), names, F.lit("\n\n| Gate | Status | Score | Coverage |\n|------|--------|-------|----------|\n"), F.col("_rows")
    )
    details = by_category.withColumn("_t", table).groupBy("project_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_c", "_t"))), lambda x: x["_t"]), "\n\n").alias("_details")
    )
    all_rows = summary.join(details, "project_id").join(findings, "project_id", "left")
    total = F.col("passed_gates") + F.col("warning_gates") + F.col("failed_gates")
    text = lambda v: F.col(v).cast("string")
    if style == "text":
        parts = [
            F.lit("HARD GATE ASSESSMENT REPORT\n" + "=" * 50 + f"\n\nGenerated: {generated}\n\nOVERALL SCORE: "), fixed1("overall_score"),
            F.lit("%\nFILES ANALYZED: "), text("total_files"), F.lit("\nLINES OF CODE: "), F.format_number("total_lines", 0),
            F.lit("\n\nGATE SUMMARY:\n- Implemented: "), text("passed_gates"), F.lit("\n- Failed: "), text("failed_gates"),
            F.lit("\n- Total Applicable: "), total.cast("string"), F.lit("\n\n"),
            F.when(F.size("recommendations") > 0, F.concat(F.lit("RECOMMENDATIONS:\n"), _numbered("recommendations", 3), F.lit("\n\n"))).otherwise(""),
        ]
    else:
        issues = F.array_join(F.transform("critical_issues", lambda t: F.concat(F.lit("- 🚨 "), t)), "\n")
        parts = [
            F.lit(f"## 🛡️ Hard Gate Assessment Report\n\n**Generated:** {generated}\n\n---\n\n### 📊 Executive Summary\n\n"
                  "| Metric | Value |\n|--------|-------|\n| **Overall Score** | **"), fixed1("overall_score"),
            F.lit("%** |\n| Total Gates | "), (total + F.col("not_applicable_gates")).cast("string"),
            F.lit(" |\n| ✅ Implemented | "), text("passed_gates"), F.lit(" |\n| ⚠️ Partial | "), text("warning_gates"),
            F.lit(" |\n| ❌ Failed | "), text("failed_gates"), F.lit(" |\n| 🚫 Not Applicable | "), text("not_applicable_gates"),
            F.lit(" |\n| Files Analyzed | "), text("total_files"), F.lit(" |\n| Lines of Code | "), F.format_number("total_lines", 0),
            F.lit(" |\n\n"), lookup(compliance_band(), COMPLIANCE_TEXT), F.lit("\n\n### 🔍 Gate Details\n\n"), F.col("_details"), F.lit("\n\n"),
            F.when(F.size("recommendations") > 0, F.concat(F.lit("### 💡 Recommendations\n\n"), _numbered("recommendations", 5), F.lit("\n\n"))).otherwise(""),
            F.when(F.size("critical_issues") > 0, F.concat(F.lit("### ⚠️ Critical Issues\n\n"), issues, F.lit("\n\n"))).otherwise(""),
            F.lit("---\n"),
        ]
    return all_rows.select("project_id", compliance_band().alias("compliance"), F.concat(*parts).alias("comment"))


def size_text(size="size"):
    n = col(size)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(fixed1(n / 1024), F.lit(" KB")))
        .otherwise(F.concat(fixed1(n / (1024 * 1024)), F.lit(" MB")))
    )


def scan_id(name="file_name"):
    """The scan a saved report belongs to, from its file name."""
    stem = F.regexp_replace(col(name), r"\.[^.]+$", "")
    return F.replace(stem, F.lit("hard_gate_report_"), F.lit(""))


def report_listing(saved: DataFrame, runs: DataFrame) -> DataFrame:
    """Saved reports (file_name, size, modified) with the state of their scan, newest first."""
    listed = saved.withColumn("scan_id", scan_id()).withColumn("size_text", size_text())
    joined = listed.join(runs.select("scan_id", "status", "score"), "scan_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("unknown"))).orderBy(F.desc("modified"), "scan_id")


def expired_reports(saved: DataFrame, days, now) -> DataFrame:
    return saved.where(F.col("modified") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def comments_hash(comments="comments"):
    """Eight characters of the md5 of a comment map, written as JSON with sorted keys."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    pairs = F.transform(
        F.sort_array(F.map_entries(comments)),
        lambda e: F.concat(F.lit('"'), quoted(e["key"]), F.lit('": "'), quoted(e["value"]), F.lit('"')),
    )
    return F.substring(F.md5(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))), 1, 8)


# ---------------------------------------------------------------- editor views


def editor_status(score="final_score"):
    return bands(score, [(80, "PASSED"), (60, "WARNING")], "FAILED")


ISSUE_SEVERITY = {"FAILED": "error", "WARNING": "warning", "PASSED": "info"}


def issues(scores: DataFrame, found: DataFrame) -> DataFrame:
    """Single issues (project_id, gate, path, line_no, column_no, message) with the grade of their gate."""
    graded = scores.select("project_id", "gate", editor_status().alias("gate_status"))
    return found.join(graded, ["project_id", "gate"]).withColumn("severity", lookup("gate_status", ISSUE_SEVERITY))


def issue_counts(listed: DataFrame) -> DataFrame:
    return listed.groupBy("project_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


def diagnostics(listed: DataFrame) -> DataFrame:
    """Editor marks for the issues of failed gates: 0-based line, ten columns wide."""
    line = F.greatest(F.coalesce("line_no", F.lit(1)) - 1, F.lit(0))
    start = F.coalesce("column_no", F.lit(0))
    return listed.where(F.col("gate_status") == "FAILED").select(
        "project_id", "gate", "path", line.cast("bigint").alias("line"), start.cast("bigint").alias("start_column"),
        (start + 10).cast("bigint").alias("end_column"),
        F.concat(F.col("gate"), F.lit(": "), F.col("message")).alias("text"), "severity",
    )


def gates_by_tier(scores: DataFrame) -> DataFrame:
    weight = gate_weight("gate", D.VIEW_WEIGHTS)
    return scores.select(
        "project_id", "gate", title_words("gate").alias("label"), weight.alias("view_weight"),
        bands(weight, D.VIEW_TIER_BANDS, D.VIEW_TIER_ELSE).alias("tier"),
    )


READINESS = [(80, "Production Ready"), (60, "Needs Improvement")]


def compliance(scores: DataFrame) -> DataFrame:
    """Passed share and counts of a project, with a label for its rounded overall score.

    ``scores`` holds project_id, final_score and overall_score.
    """
    status = editor_status()
    counted = scores.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_gates"),
        F.count_if(status == "PASSED").alias("passed"),
        F.count_if(status == "WARNING").alias("warning"),
        F.count_if(status == "FAILED").alias("failed"),
        F.floor(F.max("overall_score") + 0.5).alias("score"),
    )
    return counted.withColumn("compliance_percentage", F.col("passed") / F.col("total_gates") * 100).withColumn(
        "readiness", bands("score", READINESS, "Not Production Ready")
    )


def preview(text, n):
    return F.when(F.length(col(text)) > n, F.concat(F.substring(col(text), 1, n), F.lit("..."))).otherwise(col(text))


def recommendation_rows(advice: DataFrame) -> DataFrame:
    """Advice of gates (gate, advice) as labelled rows with a short preview."""
    label = F.concat(title_words("gate"), F.lit(": "), preview("advice", 50))
    return advice.withColumn("label", label).withColumn("general_label", preview("advice", 60))


def api_gates(scores: DataFrame, details="details") -> DataFrame:
    """The API's view of gates: status by score, at most five details or a line on counts and coverage."""
    fallback = F.array(
        F.format_string("Expected: %d, Found: %d", "expected", "found"),
        F.concat(F.lit("Coverage: "), fixed1("coverage"), F.lit("%")),
    )
    status = F.when(F.col("status") == "NOT_APPLICABLE", "NOT_APPLICABLE").otherwise(view_status())
    kept = F.slice(F.col(details), 1, 5)
    return scores.withColumn("status", status).withColumn(
        details, F.when(F.coalesce(F.size(F.col(details)), F.lit(0)) > 0, kept).otherwise(fallback)
    )


def component_declarations(components: DataFrame) -> DataFrame:
    """Component facts with defaults and one row per declaration (name, yes or no)."""
    text = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return components.select(
        "component_name",
        text("business_criticality", "Medium"),
        text("current_environment", "Unknown"),
        text("application_type", "Unknown"),
        F.explode_outer("component_declarations").alias("declaration", "is_yes"),
    )


def newest_first(reports: DataFrame, time="scan_ts", tie="project_id") -> DataFrame:
    return reports.orderBy(F.desc(time), tie)


def score_trend(reports: DataFrame, block_days=30) -> DataFrame:
    """Change of the score since the previous scan of the project (project_id, scan_id, scan_ts, score)."""
    before = with_previous(reports, ["project_id"], "scan_ts", "scan_id", "score", block_days * 86_400, "previous_score")
    return before.withColumn("change", F.col("score") - F.col("previous_score"))


def distinct_recommendations(texts="recommendations"):
    """The list without repeats; the first of equal texts stays in place."""
    return F.array_distinct(F.coalesce(F.col(texts), F.array().cast("array<string>")))


def truncated(texts, n=5):
    return F.slice(F.col(texts), 1, n)
