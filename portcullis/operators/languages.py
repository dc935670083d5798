"""Language detection, per file and per project."""

from pyspark.sql import DataFrame, Window, functions as F

from ..dims.languages import CONTENT_PATTERNS, LANGUAGE_ORD, LANGUAGES, MANIFESTS
from ..functions.blocks import reach, text_blocks
from ..functions.patterns import PLAIN
from ..functions.ranking import top_per
from ..functions.tables import computed_once
from ..functions.text import col, lookup
from ..sources.files import known_language, manifest_test

DETECTED_FROM = 30.0


def _hits(head, patterns):
    total = F.lit(0)
    for p in patterns:
        total = total + head.rlike(PLAIN + p).cast("int")
    return total


def file_language(files: DataFrame, chars=None) -> DataFrame:
    """Language by suffix, else by two signs of a language in the text; ``chars`` reads only so many characters.

    ``chars=dims.languages.CLASSIFY_CHARS`` gives the known short reading.
    """
    # The head is a column of its own, so that it is cut once and not once per pattern.
    headed = files.withColumn("_head", F.col("content") if chars is None else F.substring("content", 1, chars))
    head = F.col("_head")
    guess = F.coalesce(
        *[F.when(_hits(head, patterns) >= 2, F.lit(lang)) for lang, patterns in CONTENT_PATTERNS.items()]
    )
    known = known_language()
    # ``when`` keeps the content tests away from files with a known suffix.
    named = computed_once(headed, "language", F.when(known.isNotNull(), known).otherwise(guess))
    return named.drop("_head")


def content_hits(language="language", content="content", chars=None):
    """How many signs of its language a file shows; ``chars`` reads only so many characters (known: dims.languages.SCORE_CHARS)."""
    head, out = F.col(content) if chars is None else F.substring(F.col(content), 1, chars), F.lit(0)
    tests = [(F.col(language) == lang, _hits(head, ps)) for lang, ps in CONTENT_PATTERNS.items()]
    out = F.when(*tests[0])
    for test, value in tests[1:]:
        out = out.when(test, value)
    return F.coalesce(out, F.lit(0))


def signs_of_lines(lines: DataFrame) -> DataFrame:
    """How many signs of its language each file of a line table shows (``content_matches``), as in the whole file.

    Files are read in blocks of bounded size with a few lines before them, since a sign may go over line breaks. One
    bit stands for each sign, so that the blocks of a file add up whatever their order.
    """
    blocks = text_blocks(lines, reach([p for ps in CONTENT_PATTERNS.values() for p in ps]))
    bits = None
    for lang, patterns in CONTENT_PATTERNS.items():
        value = F.lit(0)
        for i, p in enumerate(patterns):
            value = value + F.when(F.col("whole").rlike(PLAIN + p), 1 << i).otherwise(0)
        test = F.col("language") == lang
        bits = F.when(test, value) if bits is None else bits.when(test, value)
    found = blocks.groupBy("project_id", "path", "language").agg(F.bit_or(F.coalesce(bits, F.lit(0))).alias("_bits"))
    return found.select("project_id", "path", "language", F.bit_count("_bits").alias("content_matches"))


def content_score(files: DataFrame, chars=None) -> DataFrame:
    """Signs summed per project and language."""
    return _score(files.select("project_id", "language", content_hits(chars=chars).alias("content_matches")))


def content_score_of_lines(lines: DataFrame) -> DataFrame:
    """The same for a line table."""
    return _score(signs_of_lines(lines))


def _score(signs: DataFrame) -> DataFrame:
    known = signs.where(F.col("language").isNotNull())
    return known.groupBy("project_id", "language").agg(F.sum("content_matches").cast("bigint").alias("content_matches"))


def extension_histogram(files: DataFrame, keys=("project_id",)) -> DataFrame:
    ext = F.lower("ext")
    return files.where(ext != "").groupBy(*keys, ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def config_presence(files: DataFrame) -> DataFrame:
    """Per project and language: is there a manifest?"""
    name = F.col("file_name")
    flags = files.groupBy("project_id").agg(
        *[F.bool_or(manifest_test(name, ms)).alias(lang) for lang, ms in MANIFESTS.items()]
    )
    return flags.unpivot("project_id", list(MANIFESTS), "language", "has_config")


def confidence(file_count="file_count", content_matches="content_matches", has_config="has_config"):
    return confidence_of(F.col(file_count), F.col(content_matches), col(has_config))


def confidence_of(files, content, config):
    """0 to 100 from a language's files, signs and manifest."""
    total = (
        F.least(files * 2, F.lit(40)) + F.least(content * 3, F.lit(40)) + F.when(config, F.lit(20)).otherwise(F.lit(0))
    )
    return F.least(total, F.lit(100)).cast("double")


def language_statistics(files: DataFrame, chars=None) -> DataFrame:
    """Six rows per project: files, signs, manifest and confidence, also where all are zero.

    One pass and one shuffle: every count of a project is an aggregate of the same group.
    """
    name, names = F.col("file_name"), [row["language"] for row in LANGUAGES]
    aggs = []
    for lang in names:
        here = F.col("language") == lang
        config = F.bool_or(manifest_test(name, MANIFESTS[lang])) if lang in MANIFESTS else F.lit(False)
        aggs.append(
            F.struct(
                F.lit(lang).alias("language"),
                F.count_if(here).alias("file_count"),
                F.coalesce(F.sum(F.when(here, F.col("_signs"))), F.lit(0)).cast("bigint").alias("content_matches"),
                F.coalesce(config, F.lit(False)).alias("has_config"),
            )
        )
    grouped = files.withColumn("_signs", content_hits(chars=chars)).groupBy("project_id").agg(F.array(*aggs).alias("_all"))
    return grouped.select("project_id", F.inline("_all")).withColumn("confidence", confidence())


def detect_languages(stats: DataFrame) -> DataFrame:
    """Languages with confidence 30 or more; if a project has none, the one with most files."""
    ranked = stats.withColumn("language_ord", lookup("language", LANGUAGE_ORD))
    sure = F.col("confidence") >= DETECTED_FROM
    w = Window.partitionBy("project_id")
    order = Window.partitionBy("project_id").orderBy(F.desc("file_count"), "language_ord")
    return (
        ranked.withColumn("_any", F.max(sure).over(w))
        .withColumn("_rank", F.row_number().over(order))
        .where(sure | (~F.col("_any") & (F.col("_rank") == 1) & (F.col("file_count") > 0)))
        .select("project_id", "language", "language_ord", "confidence")
    )


def primary_language(projects: DataFrame, detected: DataFrame) -> DataFrame:
    """The first detected language, python where none was detected."""
    first = detected.groupBy("project_id").agg(F.min_by("language", "language_ord").alias("_first"))
    return projects.join(first, "project_id", "left").select(
        "project_id", F.coalesce("_first", F.lit("python")).alias("language")
    )


def first_files(files: DataFrame, cap=None) -> DataFrame:
    """The first files by path per project and language; ``cap=None`` keeps all."""
    return files if cap is None else top_per(files, ["project_id", "language"], ["path"], cap).drop("rank")
