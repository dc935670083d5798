"""Code samples and prompts for a scoring model, and what becomes of its answers.

The model itself is a user function; everything around it is ordinary Spark work.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..dims import gates as D
from ..dims.hits import PATTERN_TYPE_ELSE, PATTERN_TYPES
from ..functions.ranking import top_per
from ..functions.text import col, fixed1, lookup, strip, tenths

SAMPLE_CHARS, PROMPT_CHARS, SAMPLES_KEPT = 2000, 15_000, 5
CUT_MARK = "... [truncated]"
RESULT_SCHEMA = (
    "quality_score double, patterns_found array<string>, security_issues array<string>, recommendations array<string>, "
    "technology_insights map<string,string>, code_smells array<string>, best_practices array<string>"
)


def code_samples(matches: DataFrame, n=10, order=("language", "path", "line_no", "rule_no")) -> DataFrame:
    """The text of the first hits per project and gate: matched text, else the line, else the pattern."""
    given = F.coalesce(
        F.nullif("matched_text", F.lit("")), F.nullif("full_line", F.lit("")), F.col("pattern")
    )
    first = top_per(matches, ["project_id", "gate"], order, n, "sample_no")
    return first.withColumn("sample", strip(given)).where(F.col("sample") != "").select("project_id", "gate", "sample_no", "sample")


def _relevance():
    low, out = F.lower("sample"), None
    for gate, words in D.SAMPLE_WORDS.items():
        total = sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
        out = F.when(F.col("gate") == gate, total) if out is None else out.when(F.col("gate") == gate, total)
    return out


def word_count(c):
    """Words between whitespace; 0 for blank text."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def relevant_samples(samples: DataFrame, k=SAMPLES_KEPT) -> DataFrame:
    """The most relevant samples of a gate, in stable order. Gates without words, or without any relevant
    sample, keep their first ones."""
    scored = samples.withColumn("relevance", _relevance())
    keep = (F.col("relevance") > 0) | (word_count("sample") < 10)
    by_gate = Window.partitionBy("project_id", "gate")
    judged = scored.withColumn("_keep", F.coalesce(keep, F.lit(True))).withColumn("_any", F.max("_keep").over(by_gate))
    rank = F.when(F.col("_any"), F.coalesce("relevance", F.lit(0))).otherwise(0)
    kept = judged.where(F.col("_keep") | ~F.col("_any")).withColumn("_rank", rank)
    return top_per(kept, ["project_id", "gate"], [F.desc("_rank"), "sample_no"], k, "position").select(
        "project_id", "gate", "sample_no", "sample", F.col("_rank").alias("relevance"), "position"
    )


def budget_samples(samples: DataFrame, sample_chars=SAMPLE_CHARS, prompt_chars=PROMPT_CHARS, block=4096) -> DataFrame:
    """Cuts long samples and stops before their running length exceeds the prompt size.

    Lengths are summed per (gate, block of the integer column ``position``), and only these sums run over a whole gate.
    Samples are ordered inside those blocks alone that still fit, at most ``block`` of them in one task.
    """
    long = F.length("sample") > sample_chars
    cut = samples.withColumn(
        "sample", F.when(long, F.concat(F.substring("sample", 1, sample_chars), F.lit(CUT_MARK))).otherwise(F.col("sample"))
    )
    cut = cut.withColumn("_block", F.floor(F.col("position") / block))
    keys = ["project_id", "gate", "_block"]
    sums = cut.groupBy(*keys).agg(F.sum(F.length("sample")).alias("_chars"))
    earlier = Window.partitionBy("project_id", "gate").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fitting = sums.withColumn("_before", F.sum("_chars").over(earlier)).where(F.coalesce("_before", F.lit(0)) <= prompt_chars)
    fitting = fitting.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    inside = F.sum(F.length("sample")).over(
        Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    )
    running = cut.join(fitting, same).withColumn("_inside", inside).withColumn(
        "running_chars", F.coalesce(F.col("_before") + F.col("_inside"), "_inside", "_before")
    )
    return running.where(F.col("running_chars") <= prompt_chars).select(*samples.columns, "running_chars")


def prompt_context(matches: DataFrame, results: DataFrame, n=10) -> DataFrame:
    """What a model is told about a gate: counts, distributions, files, samples and coverage.

    The sampled hits are cut to ``n`` per gate before they are gathered, the files to five by name.
    """
    keys = ["project_id", "gate"]
    counts = results.groupBy(*keys).agg(
        F.sum("expected").cast("bigint").alias("expected_count"), F.sum("found").cast("bigint").alias("found_count")
    )
    # One pass for all counts: the grades and types are fixed, and files are counted after grouping by file.
    grades = ["HIGH", "LOW", "MEDIUM"]
    types = sorted([name for name, _ in PATTERN_TYPES] + [PATTERN_TYPE_ELSE])
    per_file = matches.groupBy(*keys, "path").agg(
        *[F.count_if(F.col("severity") == g).alias(g) for g in grades],
        *[F.count_if(F.col("pattern_type") == t).alias(t) for t in types],
    )
    totals = per_file.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"), *[F.sum(c).alias(c) for c in grades + types]
    )

    def counted(names):
        entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))

    totals = totals.select(
        *keys, "total_files", counted(grades).alias("severity_distribution"), counted(types).alias("pattern_types")
    )
    paths = top_per(per_file.select(*keys, "path"), keys, ["path"], 5)
    files = paths.groupBy(*keys).agg(F.sort_array(F.collect_list("path")).alias("files_analyzed"))
    first = top_per(matches, keys, ["language", "path", "line_no", "rule_no"], n, "no")
    shown = first.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("no"), F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("matched_text").alias("code"),
                    F.col("full_line").alias("context"), "severity", "category", F.col("function_name").alias("function"),
                )
            )
        ).alias("sample_matches")
    )
    out = counts
    for part in (totals, files, shown):
        out = out.join(part, keys, "left")
    share = F.when(F.col("expected_count") > 0, F.col("found_count") / F.col("expected_count") * 100).otherwise(0.0)
    return out.withColumn("coverage_percentage", tenths(share) / 10)


def gate_prompts(context: DataFrame) -> DataFrame:
    """The prompt of every gate."""
    e = F.col("coverage_percentage")
    status = F.when(e >= 80, "PASS").when(e < 60, "FAIL").otherwise("WARNING")
    grades = F.array_join(
        F.transform(F.map_entries(F.coalesce("severity_distribution", F.create_map().cast("map<string,bigint>"))),
                    lambda x: F.concat(F.lit("- "), x["key"], F.lit(": "), x["value"].cast("string"), F.lit(" issues"))), "\n"
    )
    samples = F.array_join(
        F.transform(
            F.slice(F.col("sample_matches"), 1, 5),
            lambda x: F.concat(
                x["no"].cast("string"), F.lit(". File: "), x["file"], F.lit(", Line: "), x["line"].cast("string"), F.lit("\n   Code: "), x["code"],
                F.lit("\n   Severity: "), x["severity"], F.lit(", Function: "), x["function"],
            ),
        ),
        "\n",
    )
    prompt = F.concat(
        F.lit("Gate: "), F.col("gate"), F.lit("\nCoverage: "), F.col("found_count").cast("string"), F.lit("/"), F.col("expected_count").cast("string"),
        F.lit(" patterns found ("), fixed1(e), F.lit("% coverage)\nStatus: "), status,
        F.lit("\n\nSeverity Distribution:\n"), grades, F.lit("\n\nSample Code Patterns Found:\n"), F.coalesce(samples, F.lit("")),
        F.lit('\n\nGive 3 to 5 specific, actionable recommendations as a JSON object {"quality_score": <0-100>, "recommendations": [...]}.'),
    )
    return context.select("project_id", "gate", prompt.alias("prompt"), F.to_json(F.struct(*context.columns)).alias("context"))


def parse_model_response(answers: DataFrame, text="text") -> DataFrame:
    """A model's answer: the JSON object in it, else a score and a list found in the text; no answer gives nulls."""
    t = col(text)
    outer = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(outer != "", outer).otherwise(t), RESULT_SCHEMA, {"mode": "PERMISSIVE"})
    is_json = F.coalesce(F.get_json_object(F.when(outer != "", outer).otherwise(t), "$").isNotNull(), F.lit(False))
    score = F.regexp_extract(t, r"(?i)quality[_\s]*score[:\s]*(\d+(?:\.\d+)?)", 1)
    section = F.regexp_extract(t, r"(?is)recommendations?[:\s]*(.*?)(?=\n\n|\z)", 1)
    lines = F.transform(
        F.filter(F.split(section, "\n"), lambda x: strip(x) != ""),
        lambda x: strip(F.regexp_replace(x, r"^[- ]+|[- ]+$", "")),
    )
    none = F.array().cast("array<string>")
    out = answers.withColumn("_json", parsed).withColumn("is_json", is_json)
    return out.withColumn(
        "quality_score",
        F.when(t.isNull(), None).when(F.col("is_json"), F.coalesce("_json.quality_score", F.lit(50.0))).otherwise(
            F.coalesce(F.nullif(score, F.lit("")).cast("double"), F.lit(50.0))
        ),
    ).withColumn(
        "recommendations",
        F.when(t.isNull(), None)
        .when(F.col("is_json"), F.coalesce("_json.recommendations", none))
        .when(section != "", F.slice(lines, 1, 5))
        .otherwise(none),
    ).drop("_json")


def parse_recommendations(text="text", longer_than=20, n=5):
    """Advice in plain text: list marks removed, short lines dropped, the first few kept."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"^[-*•]\s*", ""), r"^\d+\.\s*", "")
    lines = F.transform(F.split(col(text), "\n"), clean)
    return F.slice(F.filter(lines, lambda x: F.length(x) > longer_than), 1, n)


def fallback_quality(matches: DataFrame) -> DataFrame:
    """Quality by severity when no model answers."""
    high = F.count_if(F.col("severity") == "HIGH")
    grouped = matches.groupBy("project_id", "gate").agg(F.count(F.lit(1)).alias("hits"), high.alias("high"))
    return grouped.withColumn("quality_score", fallback_quality_value("hits", "high"))


def fallback_quality_value(hits="hits", high="high"):
    return (
        F.when(F.coalesce(F.col(hits), F.lit(0)) == 0, 90.0)
        .when(F.col(high) > 5, 30.0)
        .when(F.col(high) > 0, 50.0)
        .otherwise(70.0)
    )


SIMPLE_SIGNS = [
    ("Logging usage detected", lambda s: s.contains("logger")),
    ("Exception handling found", lambda s: s.contains("try") & s.contains("catch")),
    ("Async pattern detected", lambda s: s.contains("async") | s.contains("await")),
]


def simple_fallback(samples: DataFrame) -> DataFrame:
    """The simple variant: a fixed quality of 60 and how many samples show each sign."""
    low = F.lower("sample")
    return samples.groupBy("project_id", "gate").agg(
        F.lit(60.0).alias("quality_score"),
        *[F.count_if(test(low)).alias(name) for (_, test), name in zip(SIMPLE_SIGNS, ("logging", "handling", "async"))],
    )


def batch_priority(gate="gate"):
    return F.when(F.col(gate).isin(D.BATCH_HIGH), 3).when(F.col(gate).isin(D.BATCH_MEDIUM), 2).otherwise(1)


def gate_batch_order(gates: DataFrame) -> DataFrame:
    return gates.withColumn("batch_priority", batch_priority()).orderBy(F.desc("batch_priority"), lookup("gate", D.GATE_ORD))


def apply_enhancement(scores: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Puts a model's quality and advice in place of the computed ones. The final score stays as it was."""
    e = enhanced.select(
        "project_id", "gate", F.col("quality_score").alias("_q"), F.col("recommendations").alias("_r"), F.col("security_issues").alias("_s")
    )
    joined = scores.join(e, ["project_id", "gate"], "left")
    none = F.array().cast("array<string>")
    given = F.size(F.coalesce("_r", none)) > 0
    return (
        joined.withColumn(
            "quality_score", F.when(F.col("_q").isNotNull(), F.greatest(F.lit(0.0), F.least("_q", F.lit(100.0)))).otherwise(F.col("quality_score"))
        )
        .withColumn("recommendations", F.when(given, F.slice("_r", 1, 3)).otherwise(F.col("recommendations")))
        .withColumn("insights", F.slice(F.coalesce("_s", none), 1, 2))
        .drop("_q", "_r", "_s")
    )


def score_with(prompts: DataFrame, fn, schema="project_id string, gate string, answer string") -> DataFrame:
    """Lets a user function answer batches of prompts on the executors.

    ``fn`` takes a list of prompts and returns a list of answers. A batch that fails is asked
    again prompt by prompt; a prompt that fails by itself has a null answer, and parsing keeps it null, so that the
    pattern score stays and ``fallback_quality`` can take over.
    """

    def asked(some):
        try:
            got = list(fn(some))
            if len(got) == len(some):
                return got
        except Exception:  # the model is outside our control
            pass
        return [None] if len(some) == 1 else [a for one in some for a in asked([one])]

    def answer(batches):
        for batch in batches:
            yield batch[["project_id", "gate"]].assign(answer=asked(batch["prompt"].tolist()))

    return prompts.select("project_id", "gate", "prompt").mapInPandas(answer, schema)
