"""From language results to gate scores, project summaries and verdicts."""

from pyspark.sql import DataFrame, functions as F

from ..dims import gates as D
from ..dims.languages import BASIC_SKIPPED_DIRS, LANGUAGE_ORD
from ..functions.tables import fixed_table
from ..functions.text import bands, col, lookup, ordered_mean
from .filters import prune_dirs
from .gates import FLAGS, gate_weight


def combine_languages(results: DataFrame, compat=False) -> DataFrame:
    """Sum of expected and found and mean quality over the languages of a project.

    Files, lines and flags of the languages, if present, are combined too, so that later steps need no
    further look at the files. ``compat`` loses the result of a language for four gates as soon as it has
    hits; see README.
    """
    kept = F.lit(True)
    if compat:
        kept = ~(F.col("gate").isin(D.COMPAT_DROPPED_GATES) & (F.col("found") > 0))
    total = lambda c: F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)).cast("bigint")
    more = []
    if "files" in results.columns:
        more += [F.sum("files").alias("total_files"), F.sum("loc").alias("total_lines")]
        more += [F.min_by("language", lookup("language", LANGUAGE_ORD)).alias("language")]
    more += [F.bool_or(f).alias(f) for f in FLAGS if f in results.columns]
    return results.groupBy("project_id", "gate").agg(
        total("expected").alias("expected"),
        total("found").alias("found"),
        F.coalesce(ordered_mean(lookup("language", LANGUAGE_ORD), "quality", kept), F.lit(0.0)).alias("quality_score"),
        *more,
    )


def coverage(expected="expected", found="found", gate="gate"):
    """Percentage of the expected hits. It may exceed 100; with nothing expected, hits count against."""
    e, n = F.col(expected), F.col(found)
    unexpected = (
        F.when(n == 0, 100.0)
        .when(F.col(gate) == D.SECRETS_GATE, 0.0)
        .otherwise(F.greatest(F.lit(0), 100 - n * 10).cast("double"))
    )
    return F.when(e > 0, n / e * 100).otherwise(unexpected)


def quality_multiplier(quality="quality_score"):
    return bands(quality, D.MULTIPLIER_BANDS, D.MULTIPLIER_ELSE)


def base_score(cov="coverage", quality="quality_score"):
    return F.col(cov) * D.COVERAGE_SHARE + F.col(quality) * D.QUALITY_SHARE


def final_score(cov="coverage", quality="quality_score", gate="gate"):
    return F.least(base_score(cov, quality) * gate_weight(gate) * quality_multiplier(quality), F.lit(100.0))


def score_breakdown(scores: DataFrame) -> DataFrame:
    """The six parts of a score."""
    return scores.select(
        "project_id",
        "gate",
        (F.col("coverage") * D.COVERAGE_SHARE).alias("coverage_contribution"),
        (F.col("quality_score") * D.QUALITY_SHARE).alias("quality_contribution"),
        base_score().alias("base_score"),
        gate_weight().alias("gate_weight"),
        quality_multiplier().alias("quality_multiplier"),
        final_score().alias("final_score"),
    )


def gate_status(score="final_score", found="found", gate="gate"):
    leak = (F.col(gate) == D.SECRETS_GATE) & (F.col(found) > 0)
    return F.when(leak, "FAIL").otherwise(bands(score, [(80, "PASS"), (60, "WARNING")], "FAIL"))


def clamp(c):
    return F.least(F.greatest(col(c), F.lit(0.0)), F.lit(100.0))


def gate_table(spark) -> DataFrame:
    rows = [(g, i, D.WEIGHTS[g], D.CATEGORY_OF[g], D.DISPLAY_NAMES[g]) for i, g in enumerate(D.GATES)]
    return fixed_table(
        spark, "gate string, gate_ord int, weight double, gate_category string, display_name string", rows
    )


def score_gates(combined: DataFrame) -> DataFrame:
    """Coverage, score and status. The score uses the coverage as it is; the stored one is clamped."""
    scored = combined.withColumn("coverage", coverage()).withColumn("final_score", final_score())
    return scored.withColumn("status", gate_status()).withColumn("coverage", clamp("coverage"))


def every_gate(projects: DataFrame) -> DataFrame:
    """Each row once per gate. The gates are a literal list, so no join is needed."""
    gates = F.split(F.lit(" ".join(D.GATES)), " ")
    return projects.select("*", F.posexplode(gates).alias("gate_ord", "gate"))


def mark_not_applicable(scores: DataFrame, applicable) -> DataFrame:
    """Gates that do not apply to their project hold zeros."""
    zero = lambda c, z: F.when(applicable, F.col(c)).otherwise(F.lit(z))
    status = F.when(applicable, F.col("status")).otherwise("NOT_APPLICABLE")
    marked = scores.withColumn("status", status)
    for c, z in (("expected", 0), ("found", 0), ("coverage", 0.0), ("quality_score", 0.0), ("final_score", 0.0)):
        marked = marked.withColumn(c, zero(c, z))
    return marked


COUNTED = ["PASS", "WARNING", "FAIL", "FAILED"]


def summary_counts(scores: DataFrame) -> DataFrame:
    status = F.col("status")
    return scores.groupBy("project_id").agg(
        F.count_if(status == "PASS").alias("passed_gates"),
        F.count_if(status == "WARNING").alias("warning_gates"),
        F.count_if(status.isin("FAIL", "FAILED")).alias("failed_gates"),
        F.count_if(status == "NOT_APPLICABLE").alias("not_applicable_gates"),
    )


def overall_score(scores: DataFrame) -> DataFrame:
    """Plain mean over the gates that count."""
    return scores.groupBy("project_id").agg(overall_value().alias("overall_score"))


def overall_value():
    counted = F.col("status").isin(COUNTED)
    return F.coalesce(ordered_mean(lookup("gate", D.GATE_ORD), "final_score", counted), F.lit(0.0))


def mean_all_gates(scores: DataFrame) -> DataFrame:
    return scores.groupBy("project_id").agg(F.avg("final_score").alias("computed_overall_score"))


def weighted_overall(scores: DataFrame) -> DataFrame:
    w = gate_weight()
    return scores.groupBy("project_id").agg(
        (F.sum(F.col("final_score") * w) / F.sum(w)).alias("weighted_overall_score")
    )


def totals(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("lines_of_code").cast("bigint").alias("total_lines")
    )


def project_findings(scores: DataFrame) -> DataFrame:
    """Critical issues and recommendations of a project, as ordered lists of at most a few texts.

    Only gates with status FAIL count; the first three of them in gate order may add their own advice.
    """
    failed = F.col("status") == "FAIL"
    grouped = scores.groupBy("project_id").agg(
        F.count_if(failed).alias("_failed"),
        overall_value().alias("_score"),
        F.bool_or(failed & (F.col("gate") == D.SECRETS_GATE)).alias("_leak"),
        # At most 15 gates per project.
        F.slice(
            F.sort_array(F.collect_list(F.when(failed, F.struct("gate_ord", "gate")))), 1, 3
        ).alias("_first"),
    )
    many, low, leak = F.col("_failed") > 5, F.col("_score") < 50, F.col("_leak")
    advice = F.transform("_first", lambda g: lookup(g["gate"], D.FAILED_GATE_ADVICE))
    some = lambda test, text: F.when(test, text)
    return grouped.select(
        "project_id",
        F.array_compact(
            F.array(
                some(many, F.format_string(D.MANY_FAILURES_ISSUE, "_failed")),
                some(low, F.lit(D.LOW_SCORE_ISSUE)),
                some(leak, F.lit(D.SECRETS_ISSUE)),
            )
        ).alias("critical_issues"),
        F.array_compact(
            F.concat(
                F.array(some(many, F.lit(D.MANY_FAILURES_ADVICE))),
                advice,
                F.array(some(low, F.lit(D.LOW_SCORE_ADVICE)), some(leak, F.lit(D.SECRETS_ADVICE))),
            )
        ).alias("recommendations"),
    )


def threshold_verdict(overall: DataFrame, threshold=70.0) -> DataFrame:
    return overall.withColumn("passed", F.col("overall_score") >= threshold)


# ---------------------------------------------------------------- histograms over hits


def distributions(matches: DataFrame) -> DataFrame:
    """Hits per severity and per pattern type, from one pass."""
    return matches.groupingSets(
        [["project_id", "gate", "severity"], ["project_id", "gate", "pattern_type"]],
        "project_id", "gate", "severity", "pattern_type",
    ).agg(F.count(F.lit(1)).alias("hits"))


def coverage_stats(matches: DataFrame) -> DataFrame:
    grade = F.col("severity")
    return matches.groupBy("project_id", "gate").agg(
        F.countDistinct("path").alias("total_files"),
        F.count_if(grade == "HIGH").alias("high_severity_count"),
        F.count_if(grade == "MEDIUM").alias("medium_severity_count"),
        F.count_if(grade == "LOW").alias("low_severity_count"),
        F.count_if(F.lower("category").contains("security")).alias("security_issues"),
        F.count_if(F.col("function_name") != "").alias("functions_affected"),
    )


def basic_project_score(files: DataFrame) -> DataFrame:
    """The fallback score from file names: tests, manifests and a readme at the top of the project.

    A file name has one suffix only, so tests show when a suffix itself contains "test".
    """
    top = ~F.col("path").contains("/")
    name = F.col("file_name")
    manifests = ["package.json", "requirements.txt", "pom.xml", "build.gradle"]
    flags = (
        prune_dirs(files, BASIC_SKIPPED_DIRS)
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("total_files"),
            F.bool_or(F.lower("ext").contains("test")).alias("has_tests"),
            F.bool_or(top & name.isin(manifests)).alias("has_config"),
            F.bool_or(top & F.lower(name).startswith("readme")).alias("has_readme"),
        )
    )
    parts = [("has_tests", "test_score", 80, 30), ("has_config", "config_score", 90, 40), ("has_readme", "doc_score", 85, 35)]
    for flag, score, yes, no in parts:
        flags = flags.withColumn(score, F.when(F.col(flag), yes).otherwise(no).cast("bigint"))
    mean = (F.col("test_score") + F.col("config_score") + F.col("doc_score")) / 3
    status = [F.when(F.col(s) >= 70, "PASS").otherwise("FAIL").alias(s.replace("_score", "_status")) for _, s, _, _ in parts]
    return flags.select("*", mean.alias("overall_score"), *status)


FEASIBILITY_BANDS = [(90, "Excellent"), (80, "Good"), (70, "Fair"), (60, "Marginal")]


def feasibility(reports: DataFrame, text="text") -> DataFrame:
    """A score read from report text, and its band."""
    found = F.regexp_extract(text, r"(?i)score[:\s]*(\d+(?:\.\d+)?)", 1)
    mentioned = F.lower(text).contains("migration_score")
    score = F.coalesce(F.when(mentioned, F.nullif(found, F.lit("")).cast("double")), F.lit(0.0))
    return reports.withColumn("score", score).withColumn("feasibility", bands("score", FEASIBILITY_BANDS, "Poor"))
