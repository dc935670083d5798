"""Reports in and out: JSON reports, hits in the static analysis exchange format."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dims.gates import EXPORT_NAMES
from ..functions.text import lookup
from ..operators.matching import BLOCK

REPORT_SCHEMA = (
    "project_name string, language string, scan_date string, overall_score double, total_files bigint, "
    "total_lines bigint, gate_summary struct<total_gates:bigint,implemented_gates:bigint,partial_gates:bigint,"
    "not_implemented_gates:bigint,not_applicable_gates:bigint>, gates array<struct<name:string,status:string,"
    "score:double,details:array<string>,expected:bigint,found:bigint,coverage:double,quality_score:double>>, "
    "critical_issues array<string>, recommendations array<string>"
)


def json_reports(summary: DataFrame, gates: DataFrame, report_summary: DataFrame, findings: DataFrame, scan_ts) -> DataFrame:
    """One report object per project. Its gate list has at most 15 entries.

    ``scan_ts`` is an argument so that a report depends on its inputs only. Gates without a column ``details`` have an
    empty list.
    """
    if "details" not in gates.columns:
        gates = gates.withColumn("details", F.array().cast("array<string>"))
    rows = gates.groupBy("project_id").agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("gate_ord"),
                        F.struct(
                            F.col("gate").alias("name"), F.col("status"), F.col("final_score").alias("score"), F.col("details"), F.col("expected"),
                            F.col("found"), F.col("coverage"), F.col("quality_score"),
                        ).alias("g"),
                    )
                )
            ),
            lambda x: x["g"],
        ).alias("gates")
    )
    stats = report_summary.select(
        "project_id",
        F.struct(
            "total_gates", "implemented_gates", "partial_gates", "not_implemented_gates",
            F.lit(0).cast("bigint").alias("not_applicable_gates"),
        ).alias("gate_summary"),
    )
    return (
        summary.join(rows, "project_id")
        .join(stats, "project_id")
        .join(findings, "project_id")
        .select(
            F.col("project_id").alias("project_name"),
            "language",
            F.date_format(F.lit(scan_ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("scan_date"),
            "overall_score", "total_files", "total_lines", "gate_summary", "gates", "critical_issues", "recommendations",
        )
    )


def write_json_reports(reports: DataFrame, path: str, mode="error"):
    """One JSON object per line, spread over files by Spark."""
    reports.write.mode(mode).json(path)


def read_json_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports with the file they came from."""
    return spark.read.schema(REPORT_SCHEMA).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The report of each project whose file name (then date) comes last."""
    picked = reports.groupBy("project_name").agg(
        F.max_by(F.struct(*[c for c in reports.columns if c != "project_name"]), F.struct("file_name", "scan_date")).alias("_r")
    )
    return picked.select("project_name", "_r.*")


def sarif_results(matches: DataFrame) -> DataFrame:
    """One flat exchange row per hit."""
    return matches.select(
        "project_id",
        F.concat(lookup("gate", EXPORT_NAMES), F.lit("_"), F.col("category")).alias("rule_id"),
        F.lower("severity").alias("level"),
        F.col("suggested_fix").alias("message"),
        F.col("path").alias("uri"),
        F.col("line_no").alias("start_line"),
        F.col("column_start").cast("bigint").alias("start_column"),
        F.col("column_end").cast("bigint").alias("end_column"),
        F.col("priority").cast("bigint").alias("priority"),
        "pattern",
        F.col("function_name").alias("function"),
        F.col("documentation_link").alias("documentation"),
    )


def _result():
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct("uri").alias("artifactLocation"),
                    F.struct(
                        F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"),
                        F.col("end_column").alias("endColumn"),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct("priority", "pattern", "function", "documentation").alias("properties"),
    )


def sarif_documents(results: DataFrame, tool="Portcullis", version="1.0.0") -> DataFrame:
    """Complete documents, one per project, file and block of lines, so no document gathers a whole project."""
    block = F.floor(F.col("start_line") / BLOCK)
    grouped = results.withColumn("_result", _result()).groupBy("project_id", "uri", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("start_line", "start_column", "rule_id", "_result"))).alias("_all")
    )
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("_all", lambda x: x["_result"]).alias("results"))
    document = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))
    return grouped.select("project_id", "uri", "block", document.alias("document"))


def write_sarif(results: DataFrame, path: str, mode="error"):
    """One document per line, in a directory per project."""
    sarif_documents(results).select("project_id", F.col("document").alias("value")).write.mode(mode).partitionBy(
        "project_id"
    ).text(path)
