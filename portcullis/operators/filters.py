"""Selection of files, repositories and hits."""

import re

from pyspark.sql import DataFrame, functions as F

from ..dims.languages import SKIPPED_DIRS
from ..functions.text import col


def glob_regex(pattern):
    """A shell pattern as a regular expression for whole path parts at the end of a path."""
    parts = []
    for part in pattern.strip("/").split("/"):
        if part == "**":
            parts.append(".*")
        else:
            parts.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part))
    return "(^|/)" + "/".join(parts) + "$"


def _literals(patterns):
    return [p for p in patterns if p]


def exclude_paths(files: DataFrame, patterns, path="path") -> DataFrame:
    """Drops files whose path contains a pattern as text or matches it as a shell pattern."""
    return files.where(~exclude_test(patterns, path))


def exclude_test(patterns, path="path"):
    """Does a path contain a pattern as text or match it as a shell pattern?"""
    test = F.lit(False)
    for p in _literals(patterns):
        test = test | col(path).contains(p)
        if set(p) & set("*?"):
            test = test | col(path).rlike(glob_regex(p))
    return test


def include_paths(files: DataFrame, patterns, path="path") -> DataFrame:
    """Keeps files that match one of the shell patterns; no patterns keep all."""
    return files.where(include_test(patterns, path)) if patterns else files


def include_test(patterns, path="path"):
    """Does a path match one of the shell patterns? Without patterns, every path does."""
    return col(path).rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(True)


def max_file_size(files: DataFrame, limit=1024 * 1024) -> DataFrame:
    """Files of at most ``limit`` bytes; ``None`` keeps all."""
    return files if limit is None else files.where(F.col("size") <= limit)


def prune_dirs(files: DataFrame, names=SKIPPED_DIRS) -> DataFrame:
    """Drops files below a version control or build directory, at any depth."""
    return files.where(~below_dirs(names))


def below_dirs(names=SKIPPED_DIRS):
    """Does a path lie below one of the directories, at any depth?"""
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def project_name(url, fallback):
    """The last part of a repository address without ``.git``."""
    trimmed = F.regexp_replace(col(url), "/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    name = F.regexp_replace(last, r"\.git$", "")
    return F.when(F.size(F.split(trimmed, "/")) >= 2, name).otherwise(col(fallback) if isinstance(fallback, str) else fallback)


def report_project_name(url, name=None):
    """The variant of the report: any address counts, with a constant for missing ones."""
    last = F.element_at(F.split(col(url), "/"), -1)
    last = F.coalesce(F.nullif(last, F.lit("")), F.lit("Repository Scan Results"))
    named = F.nullif(col(name), F.lit("")) if name is not None else F.lit(None)
    return F.when(F.coalesce(col(url), F.lit("")) != "", F.regexp_replace(last, r"\.git$", "")).otherwise(
        F.coalesce(named, F.lit("Repository Scan Results"))
    )


def classify_repo_url(df: DataFrame, url="url") -> DataFrame:
    """Host, owner and repository of an address and whether it is a usable repository address."""
    rest = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    route = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.split(F.regexp_replace(route, "^/+|/+$", ""), "/")
    low = F.lower(F.col("host"))
    n = F.size(F.col("_parts"))
    return (
        df.withColumn("host", rest)
        .withColumn("_route", route)
        .withColumn("_parts", parts)
        .withColumn("is_valid", low.contains("github") & (n >= 2))
        .withColumn("is_enterprise", low.contains("github") & (low != "github.com"))
        .withColumn(
            "api_base",
            F.when(low == "github.com", "https://api.github.com").otherwise(
                F.concat(F.lit("https://"), F.col("host"), F.lit("/api/v3"))
            ),
        )
        .withColumn("owner", F.when(n >= 2, F.element_at("_parts", 1)))
        .withColumn("repo", F.when(n >= 2, F.regexp_replace(F.element_at("_parts", 2), r"\.git$", "")))
        .withColumn(
            "is_strict_valid",
            F.col("host").endswith("github.com") & (F.col("_route") != "") & (n == 2),
        )
        .drop("_route", "_parts")
    )


def high_priority_matches(matches: DataFrame, at_least=7, severity="HIGH") -> DataFrame:
    kept = matches.where(F.col("priority") >= at_least)
    return kept if severity is None else kept.where(F.col("severity") == severity)


def applicable_gates(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("status") != "NOT_APPLICABLE")
