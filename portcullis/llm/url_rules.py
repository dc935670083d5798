"""Allow and block rules for URLs, held in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import ascii_lower

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
Rule = tuple[str, str, str]


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the last to the first under "hosts", then whole path segments under "paths".

    The part of a rule's path behind its last slash stays a text, as it may fit a part of a segment. Of two rules with
    the same host and path, the block rule wins.
    """
    root: dict = {"hosts": {}, "paths": {}, "ends": {}}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict: {verdict}")
        node = root
        for label in reversed(host.split(".")):
            node = node["hosts"].setdefault(label, {"hosts": {}, "paths": {}, "ends": {}})
        *segments, rest = path.split("/")
        for segment in segments:
            node = node["paths"].setdefault(segment, {"paths": {}, "ends": {}})
        if verdict == "block" or rest not in node["ends"]:
            node["ends"][rest] = (host + path, verdict)
    return root


def _longest(node: dict, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that starts this path, below one host's node."""
    segments, found = path.split("/"), None
    for segment in segments:
        fits = [rest for rest in node["ends"] if segment.startswith(rest)]
        if fits:
            found = node["ends"][max(fits, key=len)]
        node = node["paths"].get(segment)
        if node is None:
            return found
    # The last segment was looked up as if a slash followed it; it has none.
    return found


def decide(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the rule with the most host labels, then the longest path; None where none fits."""
    node, found = trie, None
    for label in reversed(host.split(".")):
        node = node["hosts"].get(label)
        if node is None:
            return found
        found = _longest(node, path) or found
    return found


def judge(df: DataFrame, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """All columns of df, with host, path, rule and verdict in place of columns of these names.

    Null urls and urls without "://" have an empty host and path, no rule and the default verdict. The trie is made
    from the rule list, which the caller holds in memory, and goes to the executors as a broadcast variable.
    """
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [decide(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    judged = F.pandas_udf(verdicts, "rule string, verdict string")
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    begin = F.instr(text, "://")
    rest = F.when(begin > 0, text.substr(begin + 3, F.length(text))).otherwise("")
    return (
        df.withColumns({"host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})
        .drop("rule", "verdict")
        .withColumn("_judged", judged("host", "path"))
        .select("*", "_judged.rule", "_judged.verdict")
        .drop("_judged")
    )
