"""The joins of the pipeline as operators of their own.

Fixed tables (rules, gates) are broadcast; their row counts are checked where they are built. Joins of
two tables that grow with the data are left to Spark, which broadcasts only what it has measured as small.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..dims.gates import GATES
from ..dims.rules import literal_runs
from ..functions.patterns import IGNORE_CASE
from ..functions.sifting import sifted
from ..functions.tables import fixed_table
from ..functions.text import folded
from .matching import order_rules, rule_table, with_function
from .reports import with_comments
from .scoring import every_gate, gate_table


def guarded_rules(spark, rules=None) -> DataFrame:
    """The live rules with a text (``guard``) that every line they match contains."""
    rules = order_rules(rules)
    guards = [(no, (r.word or max(literal_runs(r.pattern) or [""], key=len)).lower()) for no, r in enumerate(rules)]
    table = rule_table(spark, rules).where(~F.col("dead"))
    return table.join(fixed_table(spark, "rule_no int, guard string", guards), "rule_no")


def with_guards(rules: DataFrame, pattern="pattern") -> DataFrame:
    """Rules of a table with the longest text (``guard``) that each of their matches contains, as far as there is one.

    Rules that could match an empty text, or none at all inside a line, are left out. Only the rules pass through
    Python, once; lines do not.
    """

    @F.pandas_udf("string")
    def guard(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: max(literal_runs(p), key=len, default="") if p else None)

    live = rules.where(F.col(pattern).isNotNull() & ~F.col(pattern).contains("\\n") & ~F.rlike(F.lit(""), F.concat(F.lit(IGNORE_CASE), F.col(pattern))))
    return live.withColumn("guard", guard(pattern))


#: Lengths of the pieces that rules are found by.
PIECES = (4, 2, 1)


def _pieces(text: Column, size: int) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, some).otherwise(F.array().cast("array<string>"))


def rule_piece(guard="guard") -> Column:
    """The piece of its guard that a rule is found by: of the longest ones one by its hash; empty for rules without a guard."""
    text = F.coalesce(F.col(guard), F.lit(""))
    out = F.lit("")
    for size in reversed(PIECES):
        one = F.array_min(F.transform(_pieces(text, size), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p"))))["p"]
        out = F.when(F.length(text) >= size, one).otherwise(out)
    return out


def line_pieces(low: Column) -> Column:
    """All pieces of a line by which a rule could be found."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(low, size) for size in PIECES]))


def j1_lines_rules(lines: DataFrame, guarded: DataFrame) -> DataFrame:
    """Lines with rules of their language whose pattern occurs, as a join; for rules that are only known as a DataFrame.

    An inverted index: every rule stands under one piece of the text that its matches contain, every line under all of
    its pieces, and equal pieces of a language are joined. A filter of fixed size drops the pieces that no rule has where
    lines are read, so a line moves only with the rules that it may match; guard and pattern are tested then. Rules
    without a guard stand under the empty piece and meet all lines of their language. Joined pieces that are frequent are
    split by Spark like any other frequent key. ``search_lines`` is the faster form for rules that are known beforehand.
    """
    rules = guarded.withColumnRenamed("rule_language", "language").withColumn("_piece", rule_piece())
    low = lines.withColumn("_low", folded("line"))
    placed = low.withColumn("_piece", F.explode(line_pieces(F.col("_low"))))
    kept = sifted(placed, rules, ["language", "_piece"])
    test = F.col("_low").contains(F.col("guard")) & F.rlike("line", F.concat(F.lit(IGNORE_CASE), F.col("pattern")))
    return kept.join(rules, ["language", "_piece"]).where(test).drop("_low", "_piece", "guard")


def j2_language_rules(languages: DataFrame, rules=None) -> DataFrame:
    """How many rules each gate has for each language of a project, zero included."""
    counts = {}
    for r in order_rules(rules):
        counts[(r.gate, r.language)] = counts.get((r.gate, r.language), 0) + 1
    names = sorted({lang for _, lang in counts} | {"dotnet"})
    rows = [(g, lang, counts.get((g, lang), 0)) for g in GATES for lang in names]
    table = fixed_table(languages.sparkSession, "gate string, language string, rules bigint", rows)
    return languages.join(F.broadcast(table), "language")


def j3_every_gate(projects: DataFrame, scores: DataFrame) -> DataFrame:
    """Every gate of every project, with its score if there is one."""
    return every_gate(projects).join(scores, ["project_id", "gate"], "left")


def j4_language_filter(rows: DataFrame, detected: DataFrame) -> DataFrame:
    """Rows of the languages detected in their project."""
    return rows.join(detected, ["project_id", "language"], "left_semi")


def j5_gate_facts(scores: DataFrame) -> DataFrame:
    """Scores with weight, category and display name of their gate."""
    table = gate_table(scores.sparkSession).drop("gate_ord")
    return scores.join(F.broadcast(table), "gate", "left")


def j6_comments(scores: DataFrame, supplied: DataFrame, stored: DataFrame) -> DataFrame:
    return with_comments(scores, supplied, stored)


def j7_report_runs(saved: DataFrame, runs: DataFrame) -> DataFrame:
    """Saved reports with the state of their scan, 'unknown' without one."""
    joined = saved.join(runs.select("scan_id", "status"), "scan_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("unknown")))


def j8_nearest_header(rows: DataFrame, lines: DataFrame) -> DataFrame:
    return with_function(rows, lines)


def j9_without_language(files: DataFrame, classified: DataFrame) -> DataFrame:
    """Files without a detected language."""
    return files.join(classified.where(F.col("language").isNotNull()), ["project_id", "path"], "left_anti")
