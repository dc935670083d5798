"""Pattern search over lines and the description of every hit.

The search needs no join and no shuffle: each rule becomes a literal expression, guarded by texts that
its matches must contain, so a line without these texts costs a few containment tests only. Rules of
the form "call, then word" share one regex per call; the words are tested on the text inside the
brackets. Hits leave the search as (rule_no, matched_text) and take their fixed description from a
broadcast rule table whose size is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..dims import hits as H
from ..dims.languages import CONTEXT_LINES, HEADER_LOOK_BACK, HEADER_PATTERNS
from ..dims.rules import check_rules, default_rules, literal_runs
from ..functions.patterns import IGNORE_CASE, best_piece, java, quick_part
from ..functions.ranking import with_halo
from ..functions.sifting import sifted
from ..functions.tables import apart, computed_once, fixed_table, restated
from ..functions.text import count_of, folded, folded_sql, has_any, lookup, sql_text, strip, strip_left

LINE_KEYS = ["project_id", "path", "line_no"]
HIT_TYPE = "array<struct<rule_no:int,matched_text:string>>"
CALL_TYPE = "array<struct<call_no:int,whole:string,inside:string>>"
WORD_TYPE = "array<struct<word:string,nos:array<int>>>"
BLOCK = 4096
#: Blocks that a carried header is looked for in at once.
SPAN = 64


def order_rules(rules):
    """The rules in number order: all rules of a language follow each other."""
    rules = check_rules(default_rules() if rules is None else rules)
    languages = list(dict.fromkeys(r.language for r in rules))
    return [r for name in languages for r in rules if r.language == name]


def _all(tests):
    return " AND ".join(tests) if tests else "true"


def _has(texts):
    """Tests that hold for all lines that contain the texts, and few others: guards decide what is looked at, not what is found."""
    return [f"contains(_low, {sql_text(quick_part(t))})" for t in texts]


def _none(kind):
    return f"CAST(array() AS {kind})"


def _regex_hits(rules):
    """Arrays of possible hits (SQL texts) by the text they are guarded with; hits without a match hold ''."""
    groups = {}
    for no, rule in rules:
        if rule.can_match_empty:
            raise ValueError(f"rule {rule.rule_id} matches the empty text, so every line would be a hit")
        anchors = sorted(set(rule.anchors), key=lambda a: (-len(a), a))
        first = anchors[0] if anchors else ""
        hit = f"struct({no} AS rule_no, regexp_extract(line, {sql_text(java(rule.pattern))}, 0) AS matched_text)"
        rest = [a for a in anchors[1:] if a not in first]
        groups.setdefault(first, []).append(f"CASE WHEN {_all(_has(rest))} THEN {hit} END" if rest else hit)
    return {anchor: f"array({', '.join(found)})" for anchor, found in groups.items()}


def _guarded_arrays(arrays, kind, under=""):
    """Arrays behind the texts that a line must contain for them, as a list of SQL texts.

    Texts with a common piece are tested only where the piece occurs, and so on inside of each such group, so that most
    lines cost a few tests and not one for each text.
    """
    open_to, out = dict(arrays), []
    if "" in open_to:
        out.append(open_to.pop(""))
    while piece := best_piece(open_to, under):
        inside = {text: open_to.pop(text) for text in list(open_to) if piece in text}
        exact = [inside.pop(piece)] if piece in inside else []
        found = exact + _guarded_arrays(inside, kind, piece)
        out.append(f"CASE WHEN {_all(_has([piece]))} THEN flatten(array({', '.join(found)})) ELSE {_none(kind)} END")
    return out + [f"CASE WHEN {_all(_has([text]))} THEN {found} ELSE {_none(kind)} END" for text, found in open_to.items()]


def _calls(rules):
    """Logging calls in a line: number of the call, text to the last bracket, lower-cased text inside."""
    listed = list(dict.fromkeys(r.call for _, r in rules))
    found = []
    for i, call in enumerate(listed):
        guard = _all(_has([*dict.fromkeys(literal_runs(call)), ")"]))
        whole = f"regexp_extract(line, {sql_text(java(call + r'.*\)'))}, 0)"
        inside = f"regexp_extract(line, {sql_text(java(call + r'(.*)\)'))}, 1)"
        found.append(f"CASE WHEN {guard} THEN struct({i} AS call_no, {whole} AS whole, {folded_sql(inside)} AS inside) END")
    return f"array({', '.join(found)})"


def _words(rules):
    """The words of "call, then word" rules that a line with a call contains, with the rule of each call."""
    listed = list(dict.fromkeys(r.call for _, r in rules))
    words = {}
    for no, r in rules:
        words.setdefault(r.word.lower(), [None] * len(listed))[listed.index(r.call)] = no
    number = lambda no: "CAST(NULL AS INT)" if no is None else str(no)
    arrays = {w: f"array(struct({sql_text(w)} AS word, array({', '.join(map(number, nos))}) AS nos))" for w, nos in words.items()}
    found = f"flatten(array({', '.join(_guarded_arrays(arrays, WORD_TYPE))}))"
    return f"CASE WHEN exists(_calls, c -> c.whole <> '') THEN {found} ELSE {_none(WORD_TYPE)} END"


#: Hits of "call, then word" rules.
#:
#: Such a rule matches from the first call to the last closing bracket of the line, whatever the word,
#: as long as the word lies in between. So one regex per call serves all its words, and only words that the
#: line contains are looked for inside the brackets.
CALL_HITS = (
    "CASE WHEN size(_words) > 0 THEN flatten(transform(filter(_calls, c -> c.whole <> ''), c -> "
    "transform(filter(_words, w -> contains(c.inside, w.word)), "
    f"w -> struct(get(w.nos, c.call_no) AS rule_no, c.whole AS matched_text)))) ELSE {_none(HIT_TYPE)} END"
)


def _by_language(shapes, make, otherwise):
    """A CASE over the language; languages with the same rules share a branch."""
    whens = [f"WHEN language IN ({', '.join(map(sql_text, names))}) THEN {make(listed)}" for names, listed in shapes]
    return f"CASE {' '.join(whens)} ELSE {otherwise} END" if whens else otherwise


def search_lines(lines: DataFrame, rules=None, also=None) -> DataFrame:
    """Every line with every rule that matches it: the columns of ``lines``, rule_no, matched_text.

    Rows for which ``also`` holds are kept without a hit; they must be without a language. Rules are numbered as in ``order_rules``. The expression is written as SQL text, which keeps the
    planning of many rules short.
    """
    rules = order_rules(rules)
    keep, shapes, offsets = lines.columns, {}, {}
    for no, rule in enumerate(rules):
        offsets.setdefault(rule.language, no)
    for name, offset in offsets.items():
        live = [(i, r) for i, r in enumerate(r for r in rules if r.language == name) if not r.dead]
        shape = tuple((i, r.pattern, r.call, r.word) for i, r in live)
        shapes.setdefault(shape, ([], live))[0].append(name)
    shapes = [(names, live) for names, live in shapes.values() if live]
    plain = lambda listed: [(i, r) for i, r in listed if r.word is None]
    paired = lambda listed: [(i, r) for i, r in listed if r.word is not None]

    def hits(listed):
        # The lambdas in ``CALL_HITS`` and ``_words`` keep these steps out of whole-stage code, as ``apart`` does that of
        # the calls; their projections are then compiled in small methods.
        own = _guarded_arrays(_regex_hits(plain(listed)), HIT_TYPE)
        return f"flatten(array({', '.join(own + ([CALL_HITS] if paired(listed) else []))}))"

    with_calls = [(names, paired(listed)) for names, listed in shapes if paired(listed)]
    no_calls = _none(CALL_TYPE)
    hit = (F.col("_hit.matched_text") != "") & F.col("_hit.rule_no").isNotNull()
    found = (
        lines.withColumn("_low", folded("line"))
        .withColumn("_calls", apart(F.expr(_by_language(with_calls, _calls, no_calls)), "line", F.expr(no_calls)))
        .withColumn("_words", F.expr(_by_language(with_calls, _words, _none(WORD_TYPE))))
        .withColumn("_hits", F.expr(_by_language(shapes, hits, _none(HIT_TYPE))))
        # The outer form, because for the inner one the optimizer adds a filter that runs the search twice.
        .withColumn("_hit", F.explode_outer("_hits"))
        .where(hit if also is None else also | hit)
    )
    offset = lookup("language", offsets, 0) if offsets else F.lit(0)
    return found.select(*keep, (F.col("_hit.rule_no") + offset).alias("rule_no"), "_hit.matched_text")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """The rules as a DataFrame, one row per rule."""
    rules = order_rules(rules)
    rows = [
        (no, r.gate, r.language, r.ord, r.rule_id, r.pattern, r.pattern_type, r.pattern_severity,
         r.suggested_fix, r.documentation_link, r.dead, r.contextual)
        for no, r in enumerate(rules)
    ]
    return fixed_table(
        spark,
        "rule_no int, gate string, rule_language string, ord int, rule_id string, pattern string, "
        "pattern_type string, pattern_severity string, suggested_fix string, documentation_link string, "
        "dead boolean, contextual boolean",
        rows,
    )


def with_rules(found: DataFrame, rules=None) -> DataFrame:
    """Hits of ``search_lines`` with the fixed description of their rules."""
    table = rule_table(found.sparkSession, rules).drop("rule_language", "dead")
    return found.join(F.broadcast(table), "rule_no")


def match_lines(lines: DataFrame, rules=None) -> DataFrame:
    """``search_lines`` with the fixed description of each rule."""
    return with_rules(search_lines(lines, rules), rules)


def with_gates(found: DataFrame, rules=None) -> DataFrame:
    """Only what gate counts need of hits: keys, gate and matched text. The gate is looked up in a literal array."""
    gates = F.split(F.lit(" ".join(r.gate for r in order_rules(rules))), " ")
    return found.select(*LINE_KEYS, "language", F.element_at(gates, F.col("rule_no") + 1).alias("gate"), "rule_no", "matched_text")


def match_gates(lines: DataFrame, rules=None) -> DataFrame:
    """``with_gates`` of the search of some lines."""
    return with_gates(search_lines(lines.select(*LINE_KEYS, "language", "line"), rules), rules)


# ---------------------------------------------------------------- columns of a hit


def column_start(line="line", matched="matched_text", pattern="pattern", contextual="contextual"):
    """0-based start. A match that does not depend on its surroundings starts where its text first occurs."""
    first = F.instr(F.col(line), F.col(matched)) - 1
    before = F.call_function(
        "regexp_extract", F.col(line), F.concat(F.lit(IGNORE_CASE + "^(.*?)(?:"), F.col(pattern), F.lit(")")), F.lit(1)
    )
    return F.when(F.col(contextual), F.length(before)).otherwise(first).cast("int")


def with_positions(matches: DataFrame) -> DataFrame:
    return matches.withColumn("column_start", column_start()).withColumn(
        "column_end", F.col("column_start") + F.length("matched_text")
    )


def with_line_shape(matches: DataFrame) -> DataFrame:
    """Stripped line, its length, its indentation and whether it is a comment."""
    full = strip("line")
    comment = reduce(lambda a, b: a | b, [F.col("full_line").startswith(s) for s in H.COMMENT_STARTS])
    return (
        matches.withColumn("full_line", full)
        .withColumn("line_length", F.length("line"))
        .withColumn("indentation_level", F.length("line") - F.length(strip_left("line")))
        .withColumn("is_comment", comment)
    )


def in_string_literal(line="line", start="column_start"):
    """An odd number of unescaped quotes before the hit."""
    before = F.substring(F.col(line), F.lit(1), F.col(start))
    odd = [(count_of(before, q) - count_of(before, "\\" + q)) % 2 == 1 for q in ("'", '"')]
    return odd[0] | odd[1]


def severity(matched="matched_text", known="pattern_severity"):
    """The highest grade that the pattern or the matched text gives."""
    low, out = F.lower(F.col(matched)), None
    for grade, words in H.SEVERITY_WORDS:
        test = F.coalesce(F.col(known) == grade, F.lit(False)) | has_any(low, words)
        out = F.when(test, grade) if out is None else out.when(test, grade)
    return out.otherwise(H.SEVERITY_ELSE)


def category(matched="matched_text", kind="pattern_type"):
    low, out = F.lower(F.col(matched)), None
    for word in H.CATEGORY_SUFFIXES:
        value = F.concat(F.col(kind), F.lit("_" + word))
        out = F.when(low.contains(word), value) if out is None else out.when(low.contains(word), value)
    return out.otherwise(F.col(kind))


def priority(grade="severity", name="function_name"):
    low = F.lower(F.col(name))
    base = lookup(grade, H.BASE_PRIORITY, 5)
    raised = F.when(has_any(low, H.RAISING_NAMES), 2).otherwise(0)
    lowered = F.when(has_any(low, H.LOWERING_NAMES), 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(10), base + raised - lowered)).cast("int")


def header_name(line="line", language="language"):
    """The function or class a line opens, or null. Group 1 of the first pattern of the language that fits."""
    stripped, out = strip(line), None
    for name, patterns in HEADER_PATTERNS.items():
        # Case matters in these patterns, so the texts that they need are looked for in the line as it is.
        needed = [reduce(lambda a, b: a & b, [F.col(line).contains(t) for t in literal_runs(p, str)], F.lit(True)) for p in patterns]
        found = F.coalesce(*[F.when(test, F.nullif(F.regexp_extract(stripped, "(?U)" + p, 1), F.lit(""))) for test, p in zip(needed, patterns)])
        test = F.col(language) == name
        out = F.when(test, found) if out is None else out.when(test, found)
    return out


def header_lines(lines: DataFrame) -> DataFrame:
    """Lines that open a function or class. The first line of a file never counts."""
    named = computed_once(lines.where(F.col("line_no") >= 2), "function_name", header_name())
    return named.where(F.col("function_name").isNotNull())


def with_function(rows: DataFrame, lines: DataFrame, look_back=HEADER_LOOK_BACK) -> DataFrame:
    """Adds the nearest header at most ``look_back`` lines back (or on the line itself) to every row.

    With ``look_back=None`` the header may be any number of lines back. Only the rows asked about and the header lines
    are shuffled, by (project, file, block of lines); without a limit, the last header of each block is carried on.
    """
    keep = rows.columns
    headers = header_lines(lines).select(
        *LINE_KEYS,
        F.struct(
            F.col("function_name"), F.col("line_no").alias("function_line"), strip("line").alias("function_signature")
        ).alias("_header"),
    )
    asked = rows.withColumn("_block", F.floor(F.col("line_no") / BLOCK)).withColumn("_asked", F.lit(True))
    by_block = Window.partitionBy("project_id", "path", "_block").orderBy("line_no")
    if look_back is None:
        headers = headers.withColumn("_block", F.floor(F.col("line_no") / BLOCK))
        both = asked.unionByName(headers, allowMissingColumns=True).withColumn("_near", F.last("_header", ignorenulls=True).over(by_block.rangeBetween(Window.unboundedPreceding, 0)))
        found = _with_carried_headers(both, headers).where(F.col("_asked"))
    else:
        headers = with_halo(headers, ["project_id", "path"], "line_no", look_back, 0, BLOCK)
        both = asked.unionByName(headers.drop("_own"), allowMissingColumns=True)
        # The last header so far, if it is near enough: a frame that only grows, while one that moves is read again for each row.
        last = both.withColumn("_near", F.last("_header", ignorenulls=True).over(by_block.rangeBetween(Window.unboundedPreceding, 0)))
        near = F.col("line_no") - F.col("_near.function_line") <= look_back
        found = last.where(F.col("_asked")).withColumn("_near", F.when(near, F.col("_near")))
    return found.select(
        *keep,
        F.coalesce(F.col("_near.function_name"), F.lit("unknown")).alias("function_name"),
        F.coalesce(F.col("_near.function_line"), F.lit(0)).cast("bigint").alias("function_line"),
        F.coalesce(F.col("_near.function_signature"), F.lit("")).alias("function_signature"),
        F.when(F.col("_near").isNotNull(), F.col("line_no") - F.col("_near.function_line"))
        .otherwise(0)
        .cast("bigint")
        .alias("distance_from_function"),
    )


def _with_carried_headers(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Fills ``_near`` of rows in whose block no header comes before them with the last header of an earlier block.

    A header is carried through the blocks up to the next one that has headers of its own, as a range of blocks. Ranges
    are cut at multiples of a span of blocks, so that rows meet them by an equal key.
    """
    keys = ["project_id", "path"]
    last = headers.groupBy(*keys, "_block").agg(F.max_by("_header", "line_no").alias("_carried"))
    last_rows = restated(rows, *keys, "_block").groupBy(*keys).agg(F.max("_block").alias("_end"))
    following = F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block"))
    ranges = last.withColumn("_next", following).join(last_rows, keys)
    ranges = ranges.withColumn("_until", F.least(F.coalesce("_next", "_end"), "_end")).where(F.col("_block") < F.col("_until"))
    spans = F.sequence(F.floor((F.col("_block") + 1) / SPAN), F.floor(F.col("_until") / SPAN))
    placed = ranges.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.explode(spans).alias("_of_span"), F.col("_block").alias("_from"), "_until", "_carried")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    meets = [*same, F.floor(F.col("_block") / SPAN) == F.col("_of_span"), F.col("_block") > F.col("_from"), F.col("_block") <= F.col("_until")]
    return rows.join(placed, meets, "left").withColumn("_near", F.coalesce("_near", "_carried"))


def context_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds to rows (with LINE_KEYS) the three lines before and after their line, and their first and last number.

    The numbers that rows ask for, a few around each, pick the lines: a filter of fixed size drops other lines where they
    are read, so that what is shuffled grows with the rows and not with the table. Rows may repeat; those without a
    line nearby have an empty list.
    """
    # The rows are read for their lines and in the last step, which see the same table (``restated``).
    asked = restated(rows.select(*LINE_KEYS).distinct(), *LINE_KEYS)
    around = F.explode(F.sequence(F.col("line_no") - CONTEXT_LINES, F.col("line_no") + CONTEXT_LINES))
    wanted = asked.select("project_id", "path", F.col("line_no").alias("asked_no"), around.alias("line_no"))
    met = wanted.join(sifted(lines.select(*LINE_KEYS, "line"), wanted, LINE_KEYS), LINE_KEYS)
    near = F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("n"), "line")))
    found = met.groupBy("project_id", "path", "asked_no").agg(near.alias("_lines"))
    found = found.select(
        "project_id", "path", F.col("asked_no").alias("line_no"), F.transform("_lines", lambda x: x["line"]).alias("context_lines"),
        F.col("_lines")[0]["n"].alias("context_start_line"), F.element_at("_lines", -1)["n"].alias("context_end_line"),
    )
    none = F.array().cast("array<string>")
    return rows.join(found, LINE_KEYS, "left").withColumn("context_lines", F.coalesce("context_lines", none))


def with_context_lines(lines: DataFrame) -> DataFrame:
    """Adds the three lines before and after each line, and their first and last number, to all lines of a table.

    For the lines of some rows alone, ``context_of`` shuffles less.
    """
    haloed = with_halo(lines, ["project_id", "path"], "line_no", CONTEXT_LINES, CONTEXT_LINES, BLOCK)
    w = (
        Window.partitionBy("project_id", "path", "_block")
        .orderBy("line_no")
        .rowsBetween(-CONTEXT_LINES, CONTEXT_LINES)
    )
    return (
        haloed.withColumn("context_lines", F.collect_list("line").over(w))
        .withColumn("context_start_line", F.min("line_no").over(w))
        .withColumn("context_end_line", F.max("line_no").over(w))
        .where(F.col("_own"))
        .drop("_block", "_own")
    )


def describe(matches: DataFrame) -> DataFrame:
    """All columns of a hit that depend on its line and rule alone."""
    return (
        with_line_shape(with_positions(matches))
        .withColumn("is_string_literal", in_string_literal())
        .withColumn("severity", severity())
        .withColumn("category", category())
    )


def full_matches(lines: DataFrame, rules=None, context=True) -> DataFrame:
    """The complete hit records: description, function, priority and, if asked, surrounding lines.

    Only the lines around hits are gathered; lines that have them already (``explode_lines(around=...)``) keep theirs.
    """
    found = with_function(describe(match_lines(lines, rules)), lines).withColumn("priority", priority())
    return context_of(found, lines) if context and "context_lines" not in lines.columns else found


def match_summary(matches: DataFrame, keys=()) -> DataFrame:
    """Totals: hits, priority at least 7, HIGH, distinct files, distinct functions."""
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("priority") >= 7).alias("high_priority"),
        F.count_if(F.col("severity") == "HIGH").alias("security_issues"),
        F.countDistinct("project_id", "path").alias("files"),
        F.countDistinct("function_name").alias("functions"),
    )
