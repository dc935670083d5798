"""Where source text comes from. Every source yields the ``files`` columns:

project_id, path, file_name, ext, size, modified, language, content
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dims.languages import LANGUAGES, MANIFESTS
from ..functions.text import col


def file_name(path="path"):
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(name):
    """The last dot and what follows; empty for names without one or that only start with one."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def with_file_columns(files: DataFrame) -> DataFrame:
    """Adds file_name and ext (as written, with its dot)."""
    return files.withColumn("file_name", file_name()).withColumn("ext", suffix(F.col("file_name")))


def known_language(ext="ext"):
    """The language a suffix stands for, or null."""
    pairs = [(s, row["language"]) for row in LANGUAGES for s in row["suffixes"]]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.element_at(table, F.lower(col(ext)))


def utf8(content):
    """Text of bytes; invalid bytes are dropped."""
    return F.translate(F.make_valid_utf8(col(content).cast("string")), "�", "")


def read_source_tree(
    spark: SparkSession, root: str, project_depth: int = 0, glob=None, max_size=None
) -> DataFrame:
    """Files below a directory. With ``project_depth`` > 0 that many leading path parts name the project.

    Spark's file sources skip files of length 0. Give ``max_size`` to leave larger files unread: Spark then skips them by length alone.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    if max_size is not None:
        raw = raw.where(F.col("length") <= max_size)
    base = root.rstrip("/").split("://")[-1]
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), f"^.*?\\Q{base}\\E/+", "")
    if project_depth:
        project = F.regexp_extract(below, r"^((?:[^/]+/){%d})" % project_depth, 1)
        path = F.substring(below, F.length(project) + 1, F.length(below))
        project = F.regexp_replace(project, "/$", "")
    else:
        project, path = F.lit(base.split("/")[-1]), below
    return with_file_columns(
        raw.select(
            project.alias("project_id"),
            path.alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
            utf8("content").alias("content"),
        )
    ).withColumn("language", known_language())


def files_from_table(table: DataFrame, project, path, text, modified=None) -> DataFrame:
    """Files from a table that holds their text; ``project``, ``path`` and ``text`` are column expressions."""
    text = col(text)
    files = table.select(
        col(project).alias("project_id"),
        col(path).alias("path"),
        F.octet_length(text).cast("bigint").alias("size"),
        (col(modified) if modified is not None else F.lit(None)).cast("timestamp").alias("modified"),
        text.alias("content"),
    )
    return with_file_columns(files).withColumn("language", known_language())


def explode_lines(files: DataFrame, keep=("project_id", "path", "language"), around=None) -> DataFrame:
    """One row per line, numbered from 1. A carriage return stays; an empty file has one empty line.

    With ``around``, each line has so many lines before and after it, cut out of the file's text, and the numbers of the
    first and last of them.
    """
    split = F.split(F.col("content"), "\n", -1)
    number = (F.col("_pos") + 1).cast("bigint").alias("line_no")
    if around is None:
        return files.select(*keep, F.posexplode(split).alias("_pos", "line")).select(*keep, number, "line")
    rows = files.select(*keep, split.alias("_lines")).select(*keep, "_lines", F.posexplode("_lines").alias("_pos", "line"))
    first, last = F.greatest(F.col("_pos") + 1 - around, F.lit(1)), F.least(F.col("_pos") + 1 + around, F.size("_lines"))
    context = [F.slice("_lines", first, last - first + 1).alias("context_lines"), first.cast("bigint").alias("context_start_line"), last.cast("bigint").alias("context_end_line")]
    return rows.select(*keep, number, "line", *context)


def lines_from_table(table: DataFrame, project, path, line_no, text, language) -> DataFrame:
    """Lines from a table that holds one line per row."""
    return table.select(
        col(project).alias("project_id"),
        col(path).alias("path"),
        col(language).alias("language"),
        col(line_no).cast("bigint").alias("line_no"),
        col(text).alias("line"),
    )


def search_languages(files: DataFrame, languages=None) -> DataFrame:
    """Files under the language whose rules they are searched with (by suffix, not by detection).

    The general .NET language searches every name with a dot, also files of other languages, so it has
    to be asked for.
    """
    wanted = languages or [row["language"] for row in LANGUAGES if row["search_suffixes"]]
    tests = [
        F.when(
            F.col("ext").isin(row["search_suffixes"]) if row["search_suffixes"] else F.col("file_name").contains("."),
            F.lit(row["language"]),
        )
        for row in LANGUAGES
        if row["language"] in wanted
    ]
    return files.withColumn("language", F.explode(F.array_compact(F.array(*tests))))


def manifest_test(name, listed):
    """True for names in the list. An entry with a star matches names that start with the pattern."""
    exact = [m for m in listed if "*" not in m]
    test = name.isin(exact)
    for m in listed:
        if "*" in m:
            test = test | name.rlike("^" + m.replace("*", ".*"))
    return test


def manifest_files(files: DataFrame) -> DataFrame:
    """The manifest files of each language."""
    name = F.col("file_name")
    tests = [F.when(manifest_test(name, listed), F.lit(lang)) for lang, listed in MANIFESTS.items()]
    return files.select("project_id", "path", "file_name").withColumn(
        "language", F.explode(F.array_compact(F.array(*tests)))
    )
