"""What stands beside a gate's score: its details and its advice, as lists of texts.

Facts of the hits come from one aggregation: counts, and bits for kinds, tools and status codes, all of which add up.
Shown hits, longest matches and examples are picked in one step, too: every hit takes part under the roles it can have,
and of each role only the first few are kept, already before the shuffle. So both are small per project and gate when
texts are made of them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import detail_text as T, gates as D
from ..dims.languages import LANGUAGE_ORD
from ..dims.technologies import technology_rules
from ..functions.ranking import top_per
from ..functions.text import bands, has_any, lookup
from . import gates as G

SHOWN, PER_FILE, LONGEST, PER_KIND, EXAMPLES = 10, 3, 3, 2, 5
#: Status codes go from 200 to 599; each has a bit in one of these words.
FIRST_CODE, CODES, WORDS = 200, 400, 7


def _add(columns):
    return reduce(lambda a, b: a + b, columns)


def _label_bits() -> Column:
    """Which labels of its gate a hit shows."""
    low, raw, out = F.lower("matched_text"), F.col("matched_text"), F.lit(0)
    for gate, labels in D.HIT_KINDS.items():
        tests = [has_any(low, [w for w in words if w not in D.RAW_WORDS]) | has_any(raw, [w for w in words if w in D.RAW_WORDS]) for _, words in labels]
        out = F.when(F.col("gate") == gate, _add([F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)])).otherwise(out)
    tool = F.lit(0)
    for i, name in reversed(list(enumerate(D.ERROR_TOOLS))):
        tool = F.when(low.contains(name.lower()), 1 << i).otherwise(tool)
    return F.when(F.col("gate") == "ui_error_tools", tool).otherwise(out)


def _code_words() -> list[Column]:
    found = F.when(F.col("gate") == "http_codes", F.regexp_extract_all("matched_text", F.lit(D.STATUS_CODE_PATTERN), F.lit(0)))
    numbers = F.transform(found, lambda c: c.cast("int") - FIRST_CODE)

    def word(j):
        here = F.filter(numbers, lambda n: F.floor(n / 60) == j)
        return F.aggregate(here, F.lit(0).cast("bigint"), lambda a, n: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (n % 60).cast("int"))))

    return [F.coalesce(word(j), F.lit(0)) for j in range(WORDS)]


def hit_facts(hits: DataFrame) -> DataFrame:
    """Per project, gate and language: hits, files, label bits, status code bits, requests, responses and violations."""
    low = F.lower("matched_text")
    calls, secrets = F.col("gate") == "log_api_calls", F.col("gate") == D.SECRETS_GATE
    kinds, kind = [name for name, _ in D.VIOLATION_KINDS] + [D.VIOLATION_OTHER], F.when(secrets, G.violation_kind())
    marked = hits.select(*G.GATE_KEYS, "path", _label_bits().alias("labels"), *[c.alias(f"codes_{j}") for j, c in enumerate(_code_words())],
                         (calls & low.contains("request")).alias("request"), (calls & low.contains("response")).alias("response"), kind.alias("kind"))
    words = [f"codes_{j}" for j in range(WORDS)]
    counts = ["n", "requests", "responses", *[f"kind_{i}" for i in range(len(kinds))]]
    per_file = marked.groupBy(*G.GATE_KEYS, "path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("request").alias("requests"), F.count_if("response").alias("responses"),
        *[F.count_if(F.col("kind") == k).alias(f"kind_{i}") for i, k in enumerate(kinds)], *[F.bit_or(c).alias(c) for c in ["labels", *words]],
    )
    return per_file.groupBy(*G.GATE_KEYS).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in counts], *[F.bit_or(c).alias(c) for c in ["labels", *words]])


def picked_hits(hits: DataFrame) -> DataFrame:
    """Per project and gate: the hits that details name, as ``picked`` (at most a few per role, language and kind)."""
    secrets = F.col("gate") == D.SECRETS_GATE
    kind = F.when(secrets, G.violation_kind())
    none, text = F.lit(None).cast("string"), F.col("matched_text")

    def role(name, language, kind, first):
        return F.struct(F.lit(name).alias("role"), language.alias("of"), kind.alias("kind"), first.alias("first"))

    roles = F.array_compact(
        F.array(
            role("shown", none, none, F.lit(0)),
            F.when(F.col("gate") == "structured_logs", role("longest", F.col("language"), none, -F.length(text))),
            F.when(secrets & kind.isin(D.EXAMPLE_KINDS), role("example", F.col("language"), kind, F.lit(0))),
        )
    )
    each = hits.select("project_id", "gate", "language", "path", "line_no", "rule_no", text, F.inline(roles))
    kept = top_per(each, ["project_id", "gate", "role", "of", "kind"], ["first", *G.HIT_ORDER], SHOWN, "no")
    few = F.when(F.col("role") == "longest", LONGEST).when(F.col("role") == "example", PER_KIND).otherwise(SHOWN)
    shown = F.struct("role", "no", "of", "kind", "path", "line_no", "rule_no", "matched_text")
    return kept.where(F.col("no") <= few).groupBy("project_id", "gate").agg(F.sort_array(F.collect_list(shown)).alias("picked"))


def known_technologies(technologies: DataFrame) -> DataFrame:
    """Per project and language: categories with their technologies, both in the order of the rules."""
    order = {}
    for language, category, technology, _ in technology_rules():
        order.setdefault(f"{language}:{category}:{technology}", len(order))
    by = technologies.withColumn("o", lookup(F.concat_ws(":", "language", "category", "technology"), order, 9999))
    named = F.array_sort(F.collect_set(F.struct("o", "technology")))
    listed = by.groupBy("project_id", "language", "category").agg(F.min("o").alias("o"), F.transform(named, lambda x: x["technology"]).alias("names"))
    return listed.groupBy("project_id", "language").agg(F.array_sort(F.collect_list(F.struct("o", "category", "names"))).alias("technologies"))


def _format(text, *values):
    return F.format_string(text, *values)


def _if(test, text):
    return F.when(test, text)


def _language_texts(gate) -> Column:
    """The texts of one language of a gate."""
    spec, none = T.DETAILS[gate], F.array().cast("array<string>")
    n, files, labels = F.col("n"), F.col("files"), F.col("labels")
    texts = []
    if "head" in spec:
        texts.append(_format(spec["head"], n))
    if "files" in spec:
        texts.append(_format(spec["files"], files))
    named, at = D.HIT_KINDS.get(gate, []), 0
    for size, title in spec.get("kinds", []):
        shown = F.array_compact(F.array(*[F.when(labels.bitwiseAND(1 << i) != 0, named[i][0]) for i in range(at, at + size)]))
        texts.append(_if(F.size(shown) > 0, F.concat(F.lit(f"{title}: "), F.array_join(shown, ", "))))
        at += size
    if gate == "log_api_calls":
        texts += [_if(F.col("requests") > 0, _format(T.REQUESTS, "requests")), _if(F.col("responses") > 0, _format(T.RESPONSES, "responses"))]
    if gate == "http_codes":
        bit = lambda i: F.get(F.array(*[F.col(f"codes_{j}") for j in range(WORDS)]), F.floor(i / 60).cast("int"))
        codes = F.filter(F.sequence(F.lit(0), F.lit(CODES - 1)), lambda i: F.call_function("shiftright", bit(i), (i % 60).cast("int")) % 2 == 1)
        texts.append(_if(F.size(codes) > 0, F.concat(F.lit(T.CODES_USED), F.array_join(F.transform(codes, lambda i: i + FIRST_CODE), ", "))))
    if gate == "ui_error_tools":
        tools = F.array_compact(F.array(*[F.when(labels.bitwiseAND(1 << i) != 0, name) for i, name in enumerate(D.ERROR_TOOLS)]))
        texts.append(_if(F.size(tools) > 0, F.concat(F.lit(T.TOOLS_FOUND), F.array_join(tools, ", "))))
    out = F.array_compact(F.array(*texts)) if texts else none
    own = F.filter(F.coalesce("picked", F.array().cast(PICKED)), lambda x: x["of"] == F.col("language"))
    if "longest" in spec:
        out = F.concat(out, F.transform(own, lambda x: _format(spec["longest"], x["path"], F.length(x["matched_text"]))))
    if gate == D.SECRETS_GATE:
        out = F.concat(out, _violations(own))
    if "tech" in spec:
        known = F.coalesce("technologies", F.array().cast("array<struct<o:int,category:string,names:array<string>>>"))
        title = lambda c: lookup(c, {c: c.title() for _, c, _, _ in technology_rules()}, c)
        if "longest" in spec:  # the one gate that counts technologies and names the title in any case
            listed = F.transform(known, lambda x: _format("  %s: %d files", x["category"], F.size(x["names"])))
            out = F.concat(out, F.array(F.lit(spec["tech"])), listed)
        else:
            listed = F.transform(known, lambda x: F.concat(F.lit("  "), title(x["category"]), F.lit(": "), F.array_join(x["names"], ", ")))
            out = F.concat(out, F.when(F.size(known) > 0, F.array(F.lit(spec["tech"]))).otherwise(none), listed)
    return F.when(F.coalesce(n, F.lit(0)) > 0, out).otherwise(F.array(F.lit(spec["none"])))


PICKED = "array<struct<role:string,no:int,of:string,kind:string,path:string,line_no:bigint,rule_no:int,matched_text:string>>"


def _violations(own) -> Column:
    """Violations by kind, most frequent first, and a few examples of the kinds that matter most."""
    kinds = [name for name, _ in D.VIOLATION_KINDS] + [D.VIOLATION_OTHER]
    counted = F.array(*[F.struct((-F.col(f"kind_{i}")).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)])
    sorted_kinds = F.array_sort(F.filter(counted, lambda x: x["n"] < 0))
    line = lambda x: _format("  %s %s: %d violations", bands(-x["n"], T.VIOLATION_BANDS, T.VIOLATION_BAND_ELSE), x["kind"], -x["n"])
    ranked = lambda x: F.struct(lookup(x["kind"], {k: i for i, k in enumerate(D.EXAMPLE_KINDS)}).alias("k"), x["no"].alias("no"), x.alias("hit"))
    examples = F.slice(F.array_sort(F.transform(own, ranked)), 1, EXAMPLES)
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    example = lambda x: _format("   %s:%d - %s...", name(x["hit"]["path"]), x["hit"]["line_no"], F.substring(x["hit"]["matched_text"], 1, 60))
    n = F.col("n")
    return F.concat(
        F.array(F.lit(T.BY_CATEGORY)), F.transform(sorted_kinds, line), F.array(F.lit(T.EXAMPLES)), F.transform(examples, example),
        F.array_compact(F.array(_if(n > EXAMPLES, _format(T.MORE_VIOLATIONS, n - EXAMPLES)), F.lit(T.WARNING))),
    )


def _shown_texts(patterns) -> Column:
    """The first hits by file; patterns is the literal array of the rules' patterns by rule number."""
    shown = F.filter("picked", lambda x: x["role"] == "shown")
    paths = F.array_distinct(F.transform(shown, lambda x: x["path"]))

    def of_file(path):
        mine = F.filter(shown, lambda x: x["path"] == path)

        def texts(x):
            trimmed = F.trim(x["matched_text"])
            short = F.when(F.length(trimmed) > 80, F.concat(F.substring(trimmed, 1, 77), F.lit("..."))).otherwise(trimmed)
            return F.array(_format(T.MATCH, x["line_no"], short), _format(T.PATTERN, F.get(patterns, x["rule_no"])))

        more = F.when(F.size(mine) > PER_FILE, F.array(_format(T.MORE_MATCHES, F.size(mine) - PER_FILE))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(_format(T.MATCHES_OF_FILE, path)), F.flatten(F.transform(F.slice(mine, 1, PER_FILE), texts)), more)

    return F.when(F.col("_hits") > 0, F.concat(F.array(_format(T.MATCHES, F.col("_hits"))), F.flatten(F.transform(paths, of_file)))).otherwise(F.array().cast("array<string>"))


def gate_details(scores: DataFrame, results: DataFrame, hits: DataFrame, technologies: DataFrame, rules=None) -> DataFrame:
    """Adds ``details`` and ``recommendations`` to scores: the texts of every language in language order, then the first hits.

    Equal recommendations stand once, where the first of them was. Gates that do not apply say so. ``hits`` have keys,
    gate, rule_no and matched text; ``technologies`` are rows of ``detect_technologies``.
    """
    from .matching import order_rules

    joined = results.select(*G.GATE_KEYS, "expected", "found").join(hit_facts(hits), G.GATE_KEYS, "left")
    joined = joined.join(picked_hits(hits), ["project_id", "gate"], "left").join(known_technologies(technologies), ["project_id", "language"], "left")
    own = None
    for gate in D.GATES:
        test = F.col("gate") == gate
        own = F.when(test, _language_texts(gate)) if own is None else own.when(test, _language_texts(gate))
    order = lookup("language", LANGUAGE_ORD, len(LANGUAGE_ORD))
    advised = G.recommendations(joined.withColumn("_texts", own).withColumn("_o", order))
    # One row per language and advice; the texts and the picked hits of a language come along once.
    per_language = advised.groupBy(*G.GATE_KEYS, "_o").agg(
        F.first("_texts").alias("_texts"), F.first("picked").alias("picked"), F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("advice").isNotNull(), F.struct("position", "advice")))).alias("_advice"),
    )
    row = F.struct("_o", "_texts", F.transform("_advice", lambda a: a["advice"]).alias("_advice"))
    per_gate = per_language.groupBy("project_id", "gate").agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.first("picked", True).alias("picked"), F.sum(F.coalesce("n", F.lit(0))).alias("_hits"))
    patterns = F.lit([r.pattern for r in order_rules(rules)])
    flat = lambda name: F.flatten(F.transform("_rows", lambda r: r[name]))
    texts = per_gate.select("project_id", "gate", F.concat(flat("_texts"), _shown_texts(patterns)).alias("details"), F.array_distinct(flat("_advice")).alias("recommendations"))
    applies = F.col("status") != "NOT_APPLICABLE"
    found = scores.join(texts, ["project_id", "gate"], "left")
    return found.withColumn("details", F.when(applies, F.col("details")).otherwise(F.array(_format(T.NOT_APPLICABLE, "gate")))).withColumn(
        "recommendations", F.when(applies, F.col("recommendations")).otherwise(F.array(_format(T.NO_ACTION, "gate")))
    )
