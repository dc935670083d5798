"""Technologies, user interface and background jobs of a project, and the gates that apply to it.

The operators work on any table with project_id, path, language and a text column: whole files or
single lines. Flags of a file are combined with ``bool_or``, so nothing is gathered per project. Line tables give the
rows of whole files: most signs cannot go over a line break, and for those that can, blocks of lines pass on what their
last line has begun.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..dims import gates as D, technologies as T
from ..functions.blocks import BLOCK
from ..functions.patterns import WHOLE_TEXT, guarded, guarded_tests
from ..functions.ranking import top_per
from ..functions.text import folded, has_any, sql_text
from .scoring import every_gate


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def _with_technologies(rows: DataFrame, flags) -> DataFrame:
    """The technologies that a text (``_text``, folded ``_low``) shows under the rules of its language."""
    by_language = {}
    for language, category, technology, pattern in T.technology_rules():
        by_language.setdefault(language, []).append((category, technology, pattern))

    def shown(entries):
        tests = guarded_tests("_text", "_low", [pattern for _, _, pattern in entries], flags)
        names = [f"struct({sql_text(c)} AS category, {sql_text(t)} AS technology)" for c, t, _ in entries]
        listed = ", ".join(f"CASE WHEN {test} THEN {name} END" for test, name in zip(tests, names))
        return f"filter(array({listed}), r -> r IS NOT NULL)"

    found = f"CASE language {' '.join(f"WHEN '{lang}' THEN {shown(entries)}" for lang, entries in by_language.items())} END"
    return rows.select("project_id", "language", F.expr(found).alias("_found"))


def _listed(found: DataFrame) -> DataFrame:
    """One distinct row per entry. The outer form keeps the optimizer from evaluating the list twice."""
    return found.select("project_id", "language", F.inline_outer("_found")).where("technology IS NOT NULL").distinct()


def detect_technologies(files: DataFrame, text="content") -> DataFrame:
    """Technologies of each language's files. One row per project, language, category and technology."""
    rows = files.select("project_id", "language", F.col(text).alias("_text"), folded(text).alias("_low"))
    return _listed(_with_technologies(rows, WHOLE_TEXT))


def technologies_in_manifests(files: DataFrame, languages: DataFrame, code: DataFrame, text="content") -> DataFrame:
    """Technologies named in top-level manifests, for the languages of a project, if its code shows none.

    ``languages`` holds project_id and language; ``code`` the result of ``detect_technologies``.
    """
    names = [n for n in T.ROOT_MANIFESTS if "*" not in n]
    manifests = files.where(F.col("path").isin(names)).select(
        "project_id", F.col(text).alias("_text"), folded(text).alias("_low")
    )
    asked = manifests.join(languages.select("project_id", "language"), "project_id")
    found = _listed(_with_technologies(asked, "(?iuUd)"))
    return found.join(code, ["project_id", "language", "category", "technology"], "left_anti")


def sample_technologies(files: DataFrame, text="content", n=T.SAMPLED_FILES) -> DataFrame:
    """Technologies named in the first files of a project, by path."""
    low = F.lower(text)
    labels = F.array_compact(
        F.array(
            *[
                F.when(has_any(low, words), F.struct(F.lit(c).alias("category"), F.lit(label).alias("technology")))
                for c, label, words in T.SAMPLED_TECHNOLOGIES
            ]
        )
    )
    first = top_per(files, ["project_id"], ["path"], n)
    return first.select("project_id", F.inline(labels)).distinct()


def first_file_lines(lines: DataFrame, n=T.SAMPLED_FILES) -> DataFrame:
    """The lines of the first files of each project, for line tables. The file list is small per project."""
    first = top_per(lines.select("project_id", "path").distinct(), ["project_id"], ["path"], n).drop("rank")
    return lines.join(first, ["project_id", "path"], "left_semi")


def sample_technologies_of_lines(lines: DataFrame, n=T.SAMPLED_FILES) -> DataFrame:
    low = F.lower("line")
    labels = F.array_compact(
        F.array(
            *[
                F.when(has_any(low, words), F.struct(F.lit(c).alias("category"), F.lit(label).alias("technology")))
                for c, label, words in T.SAMPLED_TECHNOLOGIES
            ]
        )
    )
    return first_file_lines(lines, n).select("project_id", F.inline(labels)).distinct()


UI_MARKS = ["ui_text", "html_text", "script_text", "browser", "server", *[f"tag_{i}" for i in range(len(T.HTML_TAGS))]]


def with_marks(rows: DataFrame, text="content", *keep) -> DataFrame:
    """Per row of text: what speaks for a user interface (see ``ui_verdict``) and for background jobs."""
    low = F.col("_low")
    folded_rows = rows.withColumn("_low", folded(text))
    return folded_rows.select(
        *keep,
        guarded(text, "_low", T.UI_PATTERNS).alias("ui_text"),
        guarded(text, "_low", T.HTML_PATTERNS).alias("html_text"),
        guarded(text, "_low", T.SCRIPT_PATTERNS).alias("script_text"),
        has_any(low, T.BROWSER_WORDS).alias("browser"),
        has_any(low, T.SERVER_WORDS).alias("server"),
        *[low.contains(tag).alias(f"tag_{i}") for i, tag in enumerate(T.HTML_TAGS)],
        guarded(text, "_low", T.BACKGROUND_PATTERNS).alias("has_jobs"),
    )


def _any_of(names):
    return [F.bool_or(n).alias(n) for n in names]


#: What may stand at the end of one line and at the beginning of the next one with text.
CROSSING = [p.split(r"\s+") for p in T.UI_PATTERNS if r"\s" in p]


def _line_code(text):
    """A line's number with what it begins and what it ends, in one number; null for blank lines."""
    bits = lambda regexes: reduce(lambda a, b: a + b, [F.when(F.col(text).rlike(WHOLE_TEXT + r), 1 << i).otherwise(0) for i, r in enumerate(regexes)])
    begun = bits([rf"{before}\s*\z" for before, _ in CROSSING])
    ended = bits([rf"\A\s*{after}" for _, after in CROSSING])
    n = len(CROSSING)
    code = F.shiftleft(F.col("line_no").cast("bigint"), 2 * n) + F.shiftleft(begun, n) + ended
    return F.when(~F.col(text).rlike(r"(?U)\A\s*\z"), code)


def _goes_on(first, second):
    """Does the second line end what the first one begins?"""
    n = len(CROSSING)
    some = (1 << n) - 1
    return F.shiftright(first, n).bitwiseAND(second).bitwiseAND(F.lit(some)) != 0


def file_marks(rows: DataFrame, text="content", keys=("project_id", "path"), lines_of_code=None) -> DataFrame:
    """The marks of every file, of whole texts or of a line table (with line_no).

    Of a line table, blocks of lines are aggregated first: marks, and a number for each line with text. Neighbours are
    compared inside a block; the last number of a block is carried to the next one that has text.
    """
    more = [] if lines_of_code is None else [lines_of_code.alias("lines_of_code")]
    flags, total = [*UI_MARKS, "has_jobs"], [F.sum("lines_of_code").cast("bigint").alias("lines_of_code")] if more else []
    if "line_no" not in rows.columns:
        return with_marks(rows, text, *keys, *more).groupBy(*keys).agg(*_any_of(flags), *total)
    block = F.floor(F.col("line_no") / BLOCK).alias("_block")
    marked = with_marks(rows, text, *keys, *more, block, _line_code(text).alias("_code"))
    blocks = marked.groupBy(*keys, "_block").agg(*_any_of(flags), *total, F.sort_array(F.collect_list("_code")).alias("_codes"))
    pairs = F.zip_with(F.slice("_codes", 1, F.greatest(F.size("_codes") - 1, F.lit(0))), F.slice("_codes", 2, F.greatest(F.size("_codes"), F.lit(0))), _goes_on)
    own = blocks.select(
        *keys, "_block", *flags, *(["lines_of_code"] if more else []), F.exists(pairs, lambda x: x).alias("_inside"),
        F.get("_codes", F.lit(0)).alias("_first"), F.try_element_at("_codes", F.lit(-1)).alias("_last"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier))
    crossed = F.col("_inside") | F.coalesce(_goes_on(F.col("_before"), F.col("_first")), F.lit(False))
    return carried.withColumn("ui_text", F.col("ui_text") | crossed).groupBy(*keys).agg(*_any_of(flags), *total)


def ui_verdict():
    """Does a file (with its marks) show a user interface: by suffix, by text or by directory?"""
    tags = sum((F.col(f"tag_{i}").cast("int") for i in range(1, len(T.HTML_TAGS))), F.col("tag_0").cast("int"))
    by_text = (
        F.col("ui_text")
        | (F.col("html_text") & (tags >= T.HTML_TAGS_NEEDED))
        | (F.col("script_text") & F.col("browser") & ~F.col("server"))
    )
    suffix = _any([F.lower("path").endswith(s) for s in T.UI_SUFFIXES])
    folder = _any([F.col("path").startswith(d + "/") for d in T.UI_DIRS])
    return suffix | by_text | folder


def file_facts(rows: DataFrame, text="content", lines_of_code=None) -> DataFrame:
    """Per file: user interface, background jobs and lines of code, in one pass.

    ``lines_of_code`` is the number a row of text adds.
    """
    keys = ["project_id", "path", "language"]
    grouped = file_marks(rows, text, keys, lines_of_code)
    return grouped.select(*keys, "lines_of_code", "has_jobs", ui_verdict().alias("has_ui"))


def ui_packages(files: DataFrame, text="content") -> DataFrame:
    """Projects whose top-level package.json names a user interface package."""
    low = F.lower(text)
    quoted = [q + p + q for p in T.UI_PACKAGES for q in ('"', "'")]
    return (
        files.where(F.col("path") == "package.json")
        .groupBy("project_id")
        .agg(F.bool_or(has_any(low, quoted)).alias("by_package"))
    )


def has_ui_components(files: DataFrame, text="content") -> DataFrame:
    """Per project: does it have a user interface?"""
    per_file = file_marks(files, text)
    per_project = per_file.groupBy("project_id").agg(F.bool_or(ui_verdict()).alias("_files"))
    return per_project.join(ui_packages(files, text), "project_id", "left").select(
        "project_id", (F.col("_files") | F.coalesce("by_package", F.lit(False))).alias("has_ui")
    )


def has_background_jobs(files: DataFrame, text="content") -> DataFrame:
    """Per project: does any text show background work?"""
    return with_marks(files, text, "project_id").groupBy("project_id").agg(*_any_of(["has_jobs"]))


def applies():
    """Does a gate apply to a project with the flags has_ui and has_jobs?"""
    gate = F.col("gate")
    return (
        F.when(gate.isin(D.UI_GATES), F.coalesce("has_ui", F.lit(False)))
        .when(gate.isin(D.JOB_GATES), F.coalesce("has_jobs", F.lit(False)))
        .otherwise(F.lit(True))
    )


def gate_applicability(ui: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per project and gate: does the gate apply?"""
    flags = ui.join(jobs, "project_id", "full_outer")
    return every_gate(flags).select("project_id", "gate", applies().alias("applicable"))


def tech_stack(detected: DataFrame) -> DataFrame:
    """One report row per detected language."""
    return detected.select(
        "project_id",
        F.lit("Languages").alias("type"),
        F.initcap("language").alias("name"),
        F.lit("N/A").alias("version"),
        F.lit("detected").alias("purpose"),
    )
