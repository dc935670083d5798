import json

from pyspark.sql import functions as F

from checks import corpora as C
from portcullis.dims.rules import default_rules
from portcullis.operators import matching as M
from portcullis.streaming import scan as ST

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    lines = C.code_lines(spark, SF)
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ST.stream_matches(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(300)
    key = ["path", "line_no", "rule_id", "column_start", "severity", "category", "priority"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(key).collect())
    assert got == sorted(tuple(r) for r in ST.stream_matches(lines).select(key).collect()) and got


def test_status_stream(spark, tmp_path):
    events = C.table(spark, SF, "events").selectExpr("user_id AS scan_id", "event_type AS status", "ts")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = ST.scan_status_latest(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.table("states").collect())
    assert got == sorted(tuple(r) for r in ST.scan_status_latest(events).collect()) and got


def ended(lines):
    """Lines in order per file, each file closed by a row without text."""
    marks = lines.groupBy("project_id", "path", "language").agg((F.max("line_no") + 1).alias("line_no")).withColumn("line", F.lit(None).cast("string"))
    return lines.unionByName(marks).coalesce(1).sortWithinPartitions("project_id", "path", "line_no")


def runs(stream, tmp_path, name, mode="append"):
    """Reads what has come in, in as many small batches as there are files; returns the progress of each batch."""
    out = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True)
    query = out.start(f"{tmp_path}/{name}-out")
    query.awaitTermination(300)
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def test_streamed_functions_and_context_equal_batch(spark, tmp_path):
    """Files cut into batches at any line give the records of the whole table."""
    texts = {"a.py": "import os\ndef one():\n" + "\n".join(["    timeout = 30", "    x"] * 40) + "\ndef two():\n    timeout = 5", "b.py": "timeout = 1", "c.py": "\n\n    timeout = 2\n"}
    rules = default_rules(["timeouts"], ["python"])
    rows = [("p", f, "python", n, x) for f, t in texts.items() for n, x in enumerate(t.split("\n"), 1)]
    schema = "project_id string, path string, language string, line_no bigint, line string"
    lines = spark.createDataFrame(rows, schema)
    every = ended(lines).collect()
    for cut in ([every[:60], every[50:]]):  # some lines come again
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    progress = runs(ST.stream_full_matches(stream, rules), tmp_path, "full")
    key = ["path", "line_no", "rule_id", "matched_text", "function_name", "function_line", "function_signature", "distance_from_function", "context_lines", "context_start_line", "context_end_line", "priority", "severity"]
    plain = lambda df: sorted(json.dumps([r[k] for k in key]) for r in df.select(key).collect())
    got, want = plain(spark.read.parquet(f"{tmp_path}/full-out")), plain(M.full_matches(lines, rules))
    assert got == want and len(got) > 40
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0  # all files have ended


def test_status_frees_its_state(spark, tmp_path):
    """Finished scans leave the state soon, running ones after a day; events that are too late are dropped."""
    schema = "scan_id string, status string, ts timestamp"
    at = "2024-01-{:02d} {:02d}:00:00".format
    batches = [
        [(f"s{i}", "running", at(1, 1)) for i in range(50)] + [(None, "x", at(1, 1)), ("s1", "x", None)],
        [(f"s{i}", "completed", at(1, 2)) for i in range(40)] + [("s40", "FAILED", at(1, 2)), ("s41", "a", at(1, 2)), ("s41", "b", at(1, 2))],
        [("other", "running", at(1, 6))],
        [("s0", "running", at(1, 1)), ("s41", None, at(1, 7)), ("s1", "running", at(1, 7))],
        [("other", "running", at(4, 1))],
        [("last", "completed", at(9, 1))],
    ]
    sizes, dropped = [], 0
    for rows in batches:
        spark.createDataFrame(rows, "scan_id string, status string, ts string").select("scan_id", "status", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress = runs(ST.scan_status_bounded(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path, "scans")
        last = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
        sizes.append(last[-1]["numRowsTotal"])
        dropped += sum(s["numRowsDroppedByWatermark"] for s in last)
    got = sorted((r.scan_id, r.status, r.started.strftime("%d %H"), r.ts.strftime("%d %H"), r.events) for r in spark.read.parquet(f"{tmp_path}/scans-out").collect())
    want = [(f"s{i}", "completed", "01 01", "01 02", 2) for i in range(40)] + [("s40", "FAILED", "01 01", "01 02", 2), ("s41", "", "01 01", "01 07", 4)]
    want += [(f"s{i}", "running", "01 01", "01 01", 1) for i in range(42, 50)] + [("s1", "running", "01 07", "01 07", 1)]
    want += [("other", "running", "01 06", "01 06", 1), ("other", "running", "04 01", "04 01", 1)]
    assert got == sorted(want) and dropped == 1  # the late event of s0 neither counts nor begins a scan
    assert sizes[0] == 50 and sizes[2] <= 11 and sizes[-1] == 1
