"""Expected counts, found counts and quality of every gate.

One operator serves all gates; what differs is data in ``dims.gates``. Expected counts come from file
statistics, found counts and bonuses from one aggregation of the hits. Both shuffle only partial
aggregates, so a project with most of the files costs no more than others.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..dims import gates as D
from ..dims.advice import advice_rows
from ..functions.ranking import top_per
from ..functions.tables import apart, fixed_table
from ..functions.text import bands, has_any, is_blank, lookup

FLAGS = ["has_ui", "has_jobs"]
FILE_KEYS = ["project_id", "path", "language"]
GATE_KEYS = ["project_id", "gate", "language"]


# ---------------------------------------------------------------- file statistics


def file_analyses(lines: DataFrame) -> DataFrame:
    """Non-blank lines per file."""
    return lines.groupBy(*FILE_KEYS).agg(F.count_if(~is_blank("line")).alias("lines_of_code"))


def file_analyses_of_files(files: DataFrame) -> DataFrame:
    """The same for whole texts, without a shuffle."""
    return files.select(*FILE_KEYS, lines_of_code("content").alias("lines_of_code"))


def lines_of_code(text):
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x))).cast("bigint")


def name_counters(gates=None):
    """The counters of file names that expected counts need: column name -> words, and whether they must be absent."""
    counters = {}
    for gate in gates or D.GATES:
        spec = D.EXPECTED[gate]
        if spec["words"]:
            counters[f"named_{gate}"] = (spec["words"].split(), bool(spec.get("without")))
        if "fallback" in spec:
            counters[f"other_{gate}"] = (spec["fallback"][0].split(), False)
    return counters


def name_tests(gates=None):
    """What the path of a file says for the expected counts: column name -> test."""
    low = F.lower("path")
    named = {name: (has_any(low, words), without) for name, (words, without) in name_counters(gates).items()}
    return {name: ~test if without else test for name, (test, without) in named.items()}


def file_statistics(analyses: DataFrame, gates=None) -> DataFrame:
    """Files, lines and name counts per project and language."""
    aggs = [F.count(F.lit(1)).alias("files"), F.sum("lines_of_code").cast("bigint").alias("loc")]
    aggs += [F.count_if(apart(test, "path", F.lit(None)) if i == 0 else test).alias(name) for i, (name, test) in enumerate(name_tests(gates).items())]
    # Flags of files, if the analyses hold them, become flags of the language.
    aggs += [F.bool_or(flag).alias(flag) for flag in FLAGS if flag in analyses.columns]
    return analyses.groupBy("project_id", "language").agg(*aggs)


def _over(c, n):
    return F.floor(c / n)


def expected_count(gate):
    """Expected hits of a gate from the file statistics of a language."""
    spec = D.EXPECTED[gate]
    named = F.col(f"named_{gate}") if spec["words"] else F.lit(0)
    if "fallback" in spec:
        other = F.greatest(_over(F.col(f"other_{gate}"), spec["fallback"][1]), F.lit(1))
        named = F.when(named == 0, other).otherwise(named)
    floor = [F.lit(spec["least"]), spec["times"] * _over(named, spec.get("per", 1))]
    if "files_per" in spec:
        floor.append(_over(F.col("files"), spec["files_per"]))
    total = F.greatest(*floor)
    if "loc_per" in spec:
        total = total + _over(F.col("loc"), spec["loc_per"])
    if "add" in spec:
        total = total + spec["add"] * named
    return F.when(F.col("files") > 0, total).otherwise(0).cast("bigint")


def expected_counts(stats: DataFrame, gates=None) -> DataFrame:
    """One row per project, language and gate. Files, lines and flags of the language are repeated."""
    gates = gates or D.GATES
    keys = ["project_id", "language", "files", "loc", *[f for f in FLAGS if f in stats.columns]]
    wide = stats.select(*keys, *[expected_count(g).alias(g) for g in gates])
    return wide.unpivot(keys, gates, "gate", "expected")


# ---------------------------------------------------------------- found and quality


def _fits(bonus, low):
    if "regex" in bonus:
        return low.rlike("|".join(bonus["regex"]))
    return has_any(low, bonus["words"])


def bonus_width(gates=None):
    return max(len(D.BONUSES[g]) for g in gates or D.GATES)


def bonus_tests(gates=None):
    """Does a hit count for the first, second ... bonus of its gate? Tests of other gates are skipped per row."""
    gates = gates or D.GATES
    low, counters = F.lower("matched_text"), []
    for i in range(bonus_width(gates)):
        test = None
        for g in gates:
            if i < len(D.BONUSES[g]) and "files" not in D.BONUSES[g][i]:
                here, fits = F.col("gate") == g, _fits(D.BONUSES[g][i], low)
                test = F.when(here, fits) if test is None else test.when(here, fits)
        counters.append(F.lit(False) if test is None else F.coalesce(test, F.lit(False)))
    # Wherever hits are counted, their tests are far too many for a single method.
    return [apart(c, "matched_text", F.lit(False)) if i == 0 else c for i, c in enumerate(counters)]


def found_counts(hits: DataFrame, gates=None) -> DataFrame:
    """Found hits, distinct files and the counts behind every bonus, per project, gate and language.

    Hits are first reduced per file.
    """
    counters = bonus_tests(gates)
    width = len(counters)
    per_file = hits.groupBy(*GATE_KEYS, "path").agg(
        F.count(F.lit(1)).alias("found"), *[F.count_if(c).alias(f"bonus_{i}") for i, c in enumerate(counters)]
    )
    return per_file.groupBy(*GATE_KEYS).agg(
        F.sum("found").alias("found"),
        F.count(F.lit(1)).alias("hit_files"),
        *[F.sum(f"bonus_{i}").alias(f"bonus_{i}") for i in range(width)],
    )


def _bonus_value(gate, i):
    bonus = D.BONUSES[gate][i]
    if "files" in bonus:
        n = F.col("hit_files")
        return F.when(n >= bonus["files"], F.least(n * bonus["each"], F.lit(bonus["cap"]))).otherwise(0)
    n = F.col(f"bonus_{i}")
    if bonus.get("flat"):
        return F.when(n > 0, bonus["cap"]).otherwise(0)
    return F.least(n * bonus["each"], F.lit(bonus["cap"]))


def bonus_total(gates=None):
    """Sum of the bonuses of a row's gate."""
    out = F.lit(0)
    for g in gates or D.GATES:
        if D.BONUSES[g]:
            total = sum((_bonus_value(g, i) for i in range(1, len(D.BONUSES[g]))), _bonus_value(g, 0))
            out = F.when(F.col("gate") == g, total).otherwise(out)
    return F.coalesce(out, F.lit(0))


def quality_score(found="found", expected="expected", bonus="bonus", gate="gate"):
    """Quality of one language's result of a gate."""
    n, e = F.col(found), F.col(expected)
    usual = F.when(e == 0, F.when(n == 0, 100.0).otherwise(50.0)).otherwise(
        F.least(F.least(n / e, F.lit(1.0)) * 100 + F.col(bonus), F.lit(100.0))
    )
    secrets = F.greatest(F.lit(0), 100 - n * 10).cast("double")
    return F.when(F.col(gate) == D.SECRETS_GATE, secrets).otherwise(usual)


def gate_language_results(expected: DataFrame, found: DataFrame, gates=None) -> DataFrame:
    """Every gate for every language of a project, with or without hits."""
    counters = [c for c in found.columns if c not in GATE_KEYS]
    joined = expected.join(found, GATE_KEYS, "left").fillna(0, counters)
    more = [c for c in ["files", "loc", *FLAGS] if c in expected.columns]
    return joined.select(
        *GATE_KEYS, *more, "expected", "found", bonus_total(gates).cast("double").alias("bonus")
    ).withColumn("quality", quality_score())


def gate_result(lines: DataFrame, hits: DataFrame, gate, analyses=None) -> DataFrame:
    """One gate for all projects."""
    stats = file_statistics(file_analyses(lines) if analyses is None else analyses, [gate])
    found = found_counts(hits.where(F.col("gate") == gate), [gate])
    return gate_language_results(expected_counts(stats, [gate]), found, [gate]).drop("files", "loc")


# ---------------------------------------------------------------- facts about hits


def violation_kind(matched="matched_text"):
    """The first kind of confidential data that fits a hit."""
    low, out = F.lower(matched), None
    for name, words in D.VIOLATION_KINDS:
        test = has_any(low, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(D.VIOLATION_OTHER)


def with_violation_kind(hits: DataFrame) -> DataFrame:
    """Hits of the secrets gate with the first kind of confidential data that fits."""
    secrets = hits.where(F.col("gate") == D.SECRETS_GATE)
    return secrets.withColumn("violation_kind", violation_kind())


def violation_breakdown(hits: DataFrame) -> DataFrame:
    """Violations per project and kind with a tag; most frequent first within a project."""
    counts = with_violation_kind(hits).groupBy("project_id", "violation_kind").agg(F.count(F.lit(1)).alias("violations"))
    return counts.withColumn(
        "tag", F.when(F.col("violations") >= 5, "CRITICAL").when(F.col("violations") >= 2, "HIGH").otherwise("MEDIUM")
    ).orderBy("project_id", F.desc("violations"), "violation_kind")


def violation_severity(hits: DataFrame) -> DataFrame:
    """Counts per kind (a hit may count in several), weighted sum and kinds affected."""
    low = F.lower("matched_text")
    counted = (
        hits.where(F.col("gate") == D.SECRETS_GATE)
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("total_violations"),
            *[F.count_if(has_any(low, words)).alias(f"{name}_violations") for name, words, _ in D.VIOLATION_WEIGHTS],
        )
    )
    score, kinds = F.lit(0), F.lit(0)
    for name, _, weight in D.VIOLATION_WEIGHTS:
        n = F.col(f"{name}_violations")
        score, kinds = score + n * weight, kinds + (n > 0).cast("int")
    return counted.withColumn("severity_score", score.cast("bigint")).withColumn(
        "categories_affected", kinds.cast("bigint")
    )


HIT_ORDER = ["language", "path", "line_no", "rule_no"]


def violation_examples(hits: DataFrame, order=HIT_ORDER, per_kind=2, overall=5) -> DataFrame:
    """At most two examples for each of three kinds, at most five per project."""
    shown = with_violation_kind(hits).where(F.col("violation_kind").isin(D.EXAMPLE_KINDS))
    rank = lookup("violation_kind", {k: i for i, k in enumerate(D.EXAMPLE_KINDS)})
    first = top_per(shown, ["project_id", "violation_kind"], order, per_kind, "kind_rank")
    return top_per(
        first.withColumn("kind_ord", rank), ["project_id"], ["kind_ord", "kind_rank"], overall, "example_no"
    ).drop("kind_ord")


def gate_kinds(hits: DataFrame) -> DataFrame:
    """Per project and gate: the labels its hits show, in fixed order."""
    low, raw, labels = F.lower("matched_text"), F.col("matched_text"), []
    for gate, kinds in D.HIT_KINDS.items():
        for label, words in kinds:
            test = has_any(low, [w for w in words if w not in D.RAW_WORDS]) if set(words) - set(D.RAW_WORDS) else F.lit(False)
            for w in words:
                if w in D.RAW_WORDS:
                    test = test | raw.contains(w)
            labels.append((gate, label, (F.col("gate") == gate) & test))
    shown = hits.where(F.col("gate").isin(list(D.HIT_KINDS))).groupBy("project_id", "gate").agg(
        *[F.bool_or(test).alias(f"k{i}") for i, (_, _, test) in enumerate(labels)]
    )
    listed = F.array_compact(F.array(*[F.when(F.col(f"k{i}"), label) for i, (_, label, _) in enumerate(labels)]))
    return shown.select("project_id", "gate", listed.alias("kinds"))


def http_status_codes(hits: DataFrame) -> DataFrame:
    """The different status codes in the hits of the codes gate, per project. There are at most 400."""
    codes = hits.where(F.col("gate") == "http_codes").select(
        "project_id",
        F.explode(F.regexp_extract_all("matched_text", F.lit(D.STATUS_CODE_PATTERN), F.lit(0))).alias("code"),
    )
    return codes.distinct().groupBy("project_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def files_per_gate(hits: DataFrame) -> DataFrame:
    return hits.groupBy("project_id", "gate").agg(F.countDistinct("path").alias("files"))


def longest_matches(hits: DataFrame, k=3, order=("path", "line_no", "rule_no")) -> DataFrame:
    """The hits with the longest matched text, per project and gate."""
    sized = hits.withColumn("match_length", F.length("matched_text"))
    return top_per(sized, ["project_id", "gate"], [F.desc("match_length"), *order], k)


def request_response_counts(hits: DataFrame) -> DataFrame:
    low = F.lower("matched_text")
    return (
        hits.where(F.col("gate") == "log_api_calls")
        .groupBy("project_id")
        .agg(
            F.count_if(low.contains("request")).alias("request_logs"),
            F.count_if(low.contains("response")).alias("response_logs"),
        )
    )


def tools_detected(hits: DataFrame) -> DataFrame:
    """Error tracking tools named in the hits of their gate; a hit names the first tool in the list."""
    low, out = F.lower("matched_text"), None
    for tool in D.ERROR_TOOLS:
        test = low.contains(tool.lower())
        out = F.when(test, tool) if out is None else out.when(test, tool)
    named = hits.where(F.col("gate") == "ui_error_tools").select("project_id", out.alias("tool"))
    return named.where(F.col("tool").isNotNull()).distinct()


def advice_bucket(found="found", expected="expected", gate="gate"):
    n, e = F.col(found), F.col(expected)
    return (
        F.when(n == 0, "zero")
        .when(F.col(gate) == D.SECRETS_GATE, "quality")
        .when(n < e, "partial")
        .otherwise("quality")
    )


def advice_table(spark) -> DataFrame:
    return fixed_table(spark, "gate string, bucket string, advice_language string, position int, advice string", advice_rows())


def recommendations(results: DataFrame) -> DataFrame:
    """The advice texts of every project, gate and language, in order."""
    spark = results.sparkSession
    advice = advice_table(spark)
    has_special = F.lit(False)
    for gate, bucket, language in sorted({(r[0], r[1], r[2]) for r in advice_rows() if r[2] != "*"}):
        has_special = has_special | (
            (F.col("gate") == gate) & (F.col("bucket") == bucket) & (F.col("language") == language)
        )
    asked = results.withColumn("bucket", advice_bucket()).withColumn(
        "advice_language", F.when(has_special, F.col("language")).otherwise("*")
    )
    return asked.join(F.broadcast(advice), ["gate", "bucket", "advice_language"], "left").drop("advice_language")


# ---------------------------------------------------------------- shown hits


def shown_hits(hits: DataFrame, order=HIT_ORDER, first=10, per_file=3) -> DataFrame:
    """The first ten hits per project and gate, of these at most three per file, and how many are left out."""
    ten = top_per(hits, ["project_id", "gate"], order, first, "hit_no")
    by_file = Window.partitionBy("project_id", "gate", "path")
    numbered = ten.withColumn("file_hit_no", F.row_number().over(by_file.orderBy("hit_no"))).withColumn(
        "more", F.greatest(F.count(F.lit(1)).over(by_file) - per_file, F.lit(0))
    )
    text = F.trim("matched_text")
    return numbered.where(F.col("file_hit_no") <= per_file).withColumn(
        "shown_text", F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)
    )


def gate_weight(gate="gate", weights=None):
    return lookup(gate, weights or D.WEIGHTS, 1.0)


def gate_tier(gate="gate"):
    return bands(gate_weight(gate), D.TIER_BANDS, D.TIER_ELSE)
