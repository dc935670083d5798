"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]. Prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s3_explode_lines",
    "l1_file_language",
    "l6_language_statistics",
    "m1_match_lines",
    "m11_function_context",
    "m12_context_lines",
    "m13_priority",
    "g2_avoid_logging_secrets",
    "g12_error_logs",
    "g16_quality_score",
    "t1_detect_technologies",
    "t4_has_ui_components",
    "a1_file_analyses",
    "a8_gate_status",
    "a16_distributions",
    "w2_shown_hits",
    "w6_score_trend",
    "r4_report_rows",
    "s5_sarif_results",
    "x2_relevant_samples",
]


def main():
    from pyspark.sql import SparkSession

    from checks.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        # The whole result is computed, but not moved to Python.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
