"""What one pass over files yields: small entries that add up.

Which languages a project uses is known only when all its files have been read. So one pass over the text writes
entries for every language that a file may count for: its own language with its signs, manifests, file statistics,
marks of the whole tree, and hits of every language the file is searched under. Entries of the same kind add up, first
per file and then per project. Only these sums meet the languages that turn out to be used; text is never joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import gates as D, technologies as TD
from ..dims.languages import LANGUAGE_ORD, LANGUAGES, MANIFESTS
from ..functions.patterns import guarded
from ..functions.ranking import top_per
from ..functions.tables import computed_once
from ..functions.text import folded, has_any, lookup
from ..sources.files import manifest_test
from . import gates as G, languages as L, matching as M, technology as T
from .filters import below_dirs, exclude_test, include_test

NAMES = [row["language"] for row in LANGUAGES]
#: Kinds of entries.
TYPED, CONFIG, COUNTED, TREE, HIT = "typed", "config", "counted", "tree", "hit"


def file_measures(gates) -> list[str]:
    """The numbers of a counted file."""
    return ["loc", "ui", "jobs", *G.name_counters(gates)]


def measures(gates) -> list[str]:
    """All numbers of an entry; they add up."""
    return ["n", "signs", *file_measures(gates)]


def _entry(kind: str, language: Column, signs=None, statistics=None) -> Column:
    """An entry counts one; only that of a counted file has statistics."""
    no_signs, none = F.lit(0).cast("bigint"), F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), language.alias("language"), (no_signs if signs is None else signs.cast("bigint")).alias("signs"), (none if statistics is None else statistics).alias("m"))


def counted_languages() -> Column:
    """The languages whose file statistics a file counts for, by the end of its name."""
    name = F.col("file_name")
    ends = lambda suffixes: reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])
    return F.array_compact(F.array(*[F.when(ends(row["scan_suffixes"]), F.lit(row["language"])) for row in LANGUAGES]))


def searched_languages(languages=None) -> Column:
    """The languages under which a file is searched; the general one takes every name with a dot."""
    tests = [
        F.when(F.col("ext").isin(row["search_suffixes"]) if row["search_suffixes"] else F.col("file_name").contains("."), F.lit(row["language"]))
        for row in LANGUAGES
        if languages is None or row["language"] in languages
    ]
    return F.array_compact(F.array(*tests))


def _marks_user_interface() -> Column:
    """A directory or a top-level package list that shows a user interface, whatever the file's language."""
    folder = reduce(lambda a, b: a | b, [F.col("path").startswith(d + "/") for d in TD.UI_DIRS])
    quoted = [q + p + q for p in TD.UI_PACKAGES for q in ('"', "'")]
    package = (F.col("path") == "package.json") & has_any(F.lower("content"), quoted)
    return folder | F.coalesce(package, F.lit(False))


def _file_marks() -> Column:
    """Does a counted file show a user interface by its suffix or its text?"""
    low = F.col("_low")
    tags = reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in TD.HTML_TAGS])
    by_text = (
        guarded("content", "_low", TD.UI_PATTERNS)
        | (guarded("content", "_low", TD.HTML_PATTERNS) & (tags >= TD.HTML_TAGS_NEEDED))
        | (guarded("content", "_low", TD.SCRIPT_PATTERNS) & has_any(low, TD.BROWSER_WORDS) & ~has_any(low, TD.SERVER_WORDS))
    )
    return reduce(lambda a, b: a | b, [F.lower("path").endswith(s) for s in TD.UI_SUFFIXES]) | by_text


def with_entries(files: DataFrame, gates=None, exclude=(), include=(), max_size=None, languages=None, search_scope="all", chars=None) -> DataFrame:
    """Files with their entries and the languages under which they are searched. One row per file, no shuffle.

    Files without text count as empty. ``languages`` limits file statistics and search to these.
    """
    gates = gates or D.GATES
    small = F.lit(True) if max_size is None else F.col("size") <= max_size
    kept = include_test(include) & ~exclude_test(exclude) & small
    wanted = lambda found: found if languages is None else F.array_intersect(found, F.array(*map(F.lit, languages)))
    typed = L.file_language(files.withColumn("content", F.coalesce("content", F.lit(""))), chars)
    named = typed.withColumn("_detecting", ~below_dirs() & small).withColumn("_counted", F.when(kept, wanted(counted_languages())).otherwise(F.array().cast("array<string>")))
    counts = F.size("_counted") > 0
    tests = G.name_tests(gates)
    marked = named.withColumn("_low", F.when(counts, folded("content")))
    flags = {"ui": _file_marks(), "jobs": guarded("content", "_low", TD.BACKGROUND_PATTERNS), **tests}
    statistics = F.struct(G.lines_of_code("content").alias("loc"), *[test.cast("bigint").alias(m) for m, test in flags.items()])
    # Costly parts are columns of their own, so that each is computed once.
    measured = computed_once(marked, "_statistics", F.when(counts, statistics)).drop("_low")
    signed = computed_once(measured, "_signs", F.when(F.col("_detecting"), L.content_hits(chars=chars)))
    entries = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("_detecting"), _entry(TYPED, F.col("language"), F.col("_signs"))),
                *[F.when(F.col("_detecting") & manifest_test(F.col("file_name"), listed), _entry(CONFIG, F.lit(lang))) for lang, listed in MANIFESTS.items()],
                F.when(_marks_user_interface(), _entry(TREE, F.lit(None).cast("string"))),
            )
        ),
        F.transform("_counted", lambda lang: _entry(COUNTED, lang, statistics=F.col("_statistics"))),
    )
    searched = searched_languages(languages)
    if search_scope == "kept":
        searched = F.when(kept, searched).otherwise(F.array().cast("array<string>"))
    return signed.select("project_id", "path", "content", entries.alias("entries"), searched.alias("searched"))


def searched_entries(files: DataFrame, rules=None, gates=None, cap=None) -> DataFrame:
    """The entries and hits of ``with_entries`` in one pass over the text, added up per file.

    Columns: project_id, path, kind, language, gate, the measures and the counts behind the bonuses. ``cap`` keeps the
    statistics of so many files per language, first ones by path.
    """
    gates = gates or D.GATES
    rules = M.order_rules(rules)
    listed = F.transform("entries", lambda e: F.struct(e.alias("entry"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("line")))
    none = F.lit(None).cast(files.schema["entries"].dataType.elementType)
    lines = F.flatten(
        F.transform("searched", lambda lang: F.transform(F.split("content", "\n", -1), lambda x: F.struct(none.alias("entry"), lang.alias("language"), x.alias("line"))))
    )
    rows = files.select("project_id", "path", F.inline(F.concat(listed, lines)))
    found = M.search_lines(rows, rules, also=F.col("entry").isNotNull())
    gate_of = F.split(F.lit(" ".join(r.gate for r in rules)), " ")
    hit = F.col("entry").isNull()
    keyed = found.select(
        "project_id",
        "path",
        F.when(hit, F.lit(HIT)).otherwise(F.col("entry.kind")).alias("kind"),
        F.coalesce("entry.language", "language").alias("language"),
        F.when(hit, F.element_at(gate_of, F.col("rule_no") + 1)).alias("gate"),
        "entry.signs",
        "entry.m",
        "matched_text",
    )
    bonuses = G.bonus_tests(gates)
    per_file = keyed.groupBy("project_id", "path", "kind", "language", "gate").agg(
        F.expr("count(1) AS n"), F.expr("sum(signs) AS signs"), *[F.expr(f"sum(m.{m}) AS {m}") for m in file_measures(gates)],
        *[F.count_if(test).alias(f"bonus_{i}") for i, test in enumerate(bonuses)],
    )
    if cap is None:
        return per_file
    # The names of the files alone say where the cap falls.
    counted = files.select("project_id", "path", F.explode(F.transform(F.filter("entries", lambda e: e["kind"] == COUNTED), lambda e: e["language"])).alias("language"))
    last = top_per(counted.distinct(), ["project_id", "language"], ["path"], cap).groupBy("project_id", "language").agg(F.max("path").alias("_last"))
    return per_file.join(last, ["project_id", "language"], "left").where((F.col("kind") != COUNTED) | (F.col("path") <= F.col("_last"))).drop("_last")


def project_entries(per_file: DataFrame, gates=None) -> DataFrame:
    """One row per project with the sums of its entries: at most a few per language and gate."""
    summed = [*measures(gates or D.GATES), *[c for c in per_file.columns if c.startswith("bonus_")]]
    per_kind = per_file.groupBy("project_id", "kind", "language", "gate").agg(*[F.expr(f"sum({m}) AS {m}") for m in summed], F.expr("count(1) AS hit_files"))
    return per_kind.groupBy("project_id").agg(F.expr(f"collect_list(struct(kind, language, gate, {', '.join(summed)}, hit_files)) AS entries"))


def _of(kind: str, language: str, get="e") -> str:
    """The project's sums of a kind for a language (SQL text), or one of them; null if it has none."""
    same = "true" if language is None else f"e.language = {language}"
    return f"get(transform(filter(entries, e -> e.kind = '{kind}' AND {same}), e -> {get}), 0)"


def used_languages() -> Column:
    """Languages with confidence 30 or more; if a project has none, the one with most files."""
    stats = F.array(
        *[
            F.expr(
                f"struct(coalesce({_of(TYPED, f"'{lang}'", 'e.n')}, 0) AS files, {-LANGUAGE_ORD[lang]} AS ord, '{lang}' AS language, "
                f"coalesce({_of(TYPED, f"'{lang}'", 'e.signs')}, 0) AS signs, {_of(CONFIG, f"'{lang}'", 'e.n')} IS NOT NULL AS config)"
            )
            for lang in NAMES
        ]
    )
    sure = F.filter(stats, lambda s: L.confidence_of(s["files"], s["signs"], s["config"]) >= L.DETECTED_FROM)
    most = F.array_max(stats)
    single = F.when(most["files"] > 0, F.array(most["language"])).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(sure) > 0, F.transform(sure, lambda s: s["language"])).otherwise(single)


def language_results(projects: DataFrame, gates=None, languages=None) -> DataFrame:
    """Every gate for every used language of a project, with or without files or hits, from the sums of its entries."""
    gates = gates or D.GATES
    used = used_languages() if languages is None else F.array(*map(F.lit, languages))
    rows = projects.select("project_id", "entries", F.explode(used).alias("language")).select(
        "project_id",
        "language",
        F.expr(f"{_of(TREE, None, 'e.n')} IS NOT NULL AS _tree"),
        F.expr(f"{_of(COUNTED, 'language')} AS _counted"),
        F.expr(f"filter(entries, e -> e.kind = '{HIT}' AND e.language = language) AS _hits"),
    )
    value = lambda m: f"coalesce(_counted.{m}, 0)"
    wide = rows.selectExpr(
        "project_id",
        "language",
        "_hits",
        f"{value('n')} AS files",
        *[f"{value(m)} AS {m}" for m in ["loc", *G.name_counters(gates)]],
        f"{value('ui')} > 0 OR _tree AS has_ui",
        f"{value('jobs')} > 0 AS has_jobs",
    )
    each = F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), G.expected_count(g).alias("expected")) for g in gates]))
    asked = wide.select("project_id", "language", "files", "loc", *G.FLAGS, "_hits", each)
    hit = asked.withColumn("_hit", F.expr("get(filter(_hits, e -> e.gate = gate), 0)"))
    counters = ["hit_files", *[f"bonus_{i}" for i in range(G.bonus_width(gates))]]
    counted = hit.selectExpr(
        *G.GATE_KEYS, "files", "loc", *G.FLAGS, "expected", "coalesce(_hit.n, 0) AS found", *[f"coalesce(_hit.{c}, 0) AS {c}" for c in counters]
    )
    return counted.select(
        *G.GATE_KEYS, "files", "loc", *G.FLAGS, "expected", "found", G.bonus_total(gates).cast("double").alias("bonus")
    ).withColumn("quality", G.quality_score())
