"""Search and scan states over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..dims.languages import CONTEXT_LINES, HEADER_LOOK_BACK
from ..functions.text import strip
from ..operators import matching as M

#: Words that end a scan.
FINISHED = ("completed", "failed")


def stream_matches(lines: DataFrame, rules=None) -> DataFrame:
    """Described hits of a stream of lines. No state is kept: function names need neighbouring lines, so
    the function is taken as unknown."""
    found = M.describe(M.match_lines(lines, rules))
    named = found.withColumn("function_name", F.lit("unknown"))
    return named.withColumn("priority", M.priority())


def scan_status_latest(events: DataFrame) -> DataFrame:
    """The last state of every scan (scan_id, status, ts), for tables and streams.

    The state holds one row per scan. Equal times are decided by the status text.
    """
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "status"))
    return events.groupBy("scan_id").agg(last.alias("_last")).select("scan_id", "_last.status", "_last.ts")


SCANS = "scan_id string, started timestamp, status string, ts timestamp, events long"


def scan_status_bounded(events: DataFrame, late="1 hour", running_minutes=1440, finished_minutes=10, finished=FINISHED) -> DataFrame:
    """The last state of every scan of a stream (SCANS), with a state that holds only scans of the last while.

    A scan is over when it has been silent for so long, by the times of events: for ``finished_minutes`` after a word
    that ends it, for ``running_minutes`` otherwise. Its row is written then, once, and its state is freed; a later event
    begins a new scan of that name. Events may be ``late`` by so much; later ones are dropped. Equal times are decided
    by the status text. Rows without a scan or a time are left out.
    """
    known = events.where(F.col("scan_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = known.select(F.col("scan_id").cast("string").alias("scan_id"), F.coalesce("status", F.lit("")).alias("status"), "ts", F.unix_micros("ts").alias("us"))
    minute = 60_000_000

    def until(at: int, status: str) -> int:
        return at + (finished_minutes if status.lower() in finished else running_minutes) * minute

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = []
        if state.hasTimedOut:
            over, held = [state.get], None
            state.remove()
        else:
            held = state.get if state.exists else None
            for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.us, r.status)):
                if held and row.us > until(held[2], held[1]):
                    over.append(held)
                    held = None
                if held is None:
                    held = (row.us, row.status, row.us, 1)
                else:
                    last, status = max((held[2], held[1]), (row.us, row.status))
                    held = (min(held[0], row.us), status, last, held[3] + 1)
            state.update(held)
            # A time-out must lie behind the watermark; times are whole milliseconds there.
            state.setTimeoutTimestamp(max(until(held[2], held[1]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        columns = list(zip(*over, strict=True)) or [()] * 4
        yield pd.DataFrame({"scan_id": [key[0]] * len(over), "started": columns[0], "status": columns[1], "ts": columns[2], "events": columns[3]}).astype({"started": "int64", "ts": "int64", "events": "int64"})

    found = rows.groupBy("scan_id").applyInPandasWithState(
        advance, "scan_id string, started long, status string, ts long, events long", "started long, status string, ts long, events long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("scan_id", F.timestamp_micros("started").alias("started"), "status", F.timestamp_micros("ts").alias("ts"), "events")


LINES_IN_CONTEXT = (
    "project_id string, path string, language string, line_no bigint, line string, function_name string, function_line bigint, "
    "function_signature string, distance_from_function bigint, context_lines array<string>, context_start_line bigint, context_end_line bigint"
)


class _File:
    """What is remembered of a file: its last header, a few lines before the first that waits, and those that wait."""

    def __init__(self, kept: str | None) -> None:
        self.last, self.header, self.lines, self.done = json.loads(kept) if kept else (0, None, [], 0)

    def kept(self) -> str:
        return json.dumps([self.last, self.header, self.lines, self.done])

    def put(self, row) -> None:
        """Takes the next line; lines that come again are ignored."""
        if row.line_no <= self.last:
            return
        self.last = int(row.line_no)
        if isinstance(row.header, str):
            self.header = [row.header, self.last, row.signature]
        near = self.header if self.header and self.last - self.header[1] <= HEADER_LOOK_BACK else ["unknown", 0, ""]
        self.lines.append([self.last, row.language, row.line, *near])

    def ready(self, ended: bool) -> Iterator[tuple]:
        """The lines whose following ones are known, with their context."""
        while self.done < len(self.lines) and (ended or len(self.lines) > self.done + CONTEXT_LINES):
            number, language, line, name, at, signature = self.lines[self.done]
            around = self.lines[max(0, self.done - CONTEXT_LINES) : self.done + CONTEXT_LINES + 1]
            yield language, number, line, name, at, signature, number - at if at else 0, [x[2] for x in around], around[0][0], around[-1][0]
            self.done += 1
        spare = max(0, self.done - CONTEXT_LINES)
        self.lines, self.done = self.lines[spare:], self.done - spare


def lines_in_context(lines: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """The lines of a stream (LINES_IN_CONTEXT), each with its function and the three lines before and after it.

    The lines of a file must come in order; a row without text (null) ends its file. Then its last lines are written and
    its state is freed, or, on streams that go on (not with a trigger that ends), when it has been idle for so long by
    the clock. The state of a file is its last header and at most seven lines. Files are dealt out by their path, so a
    file is one task, as its lines come one after the other.
    """
    header = F.when(F.col("line_no") >= 2, M.header_name()).alias("header")
    named = lines.select(*M.LINE_KEYS, "language", "line", header, strip("line").alias("signature"))
    names = [f.split()[0] for f in LINES_IN_CONTEXT.split(", ")]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file, ended = _File(state.get[0] if state.exists else None), state.hasTimedOut
        rows = [] if ended else sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.line_no)
        for row in rows:
            if row.line is None:
                ended = True
            else:
                file.put(row)
        found = [(*key, *values) for values in file.ready(ended)]
        if ended:
            state.remove()
        else:
            state.update((file.kept(),))
            if idle_minutes is not None:
                state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame(found, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    return named.groupBy("project_id", "path").applyInPandasWithState(advance, LINES_IN_CONTEXT, "kept string", "append", timeout)


def stream_full_matches(lines: DataFrame, rules=None, idle_minutes: int | None = None) -> DataFrame:
    """The complete hit records of a stream of lines, as ``full_matches`` gives them for a table."""
    return M.describe(M.match_lines(lines_in_context(lines, idle_minutes), rules)).withColumn("priority", M.priority())
