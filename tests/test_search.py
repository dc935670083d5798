"""The search against brute force with Python's own regular expressions."""

import random
import re
from re import _constants as sre, _parser as sre_parser

import pytest

from portcullis.dims.rules import Rule, default_rules, literal_runs
from portcullis.operators import matching as M

RULES = default_rules()
LIVE = [r for r in RULES if not r.dead]
COMPILED = {r.rule_id: re.compile(r.pattern.replace("(?i)", ""), re.IGNORECASE) for r in LIVE}


def sample(pattern):
    """A text that the pattern matches: first choices, repeats of at least one."""

    def walk(parsed):
        out = ""
        for op, arg in parsed:
            if op is sre.LITERAL:
                out += chr(arg)
            elif op is sre.ANY or op is sre.NOT_LITERAL:
                out += " "
            elif op is sre.IN:
                out += pick(arg)
            elif op is sre.SUBPATTERN:
                out += walk(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                out += walk(arg[2]) * max(1, arg[0])
            elif op is sre.BRANCH:
                out += walk(arg[1][0])
        return out

    def pick(items):
        kinds = {sre.CATEGORY_DIGIT: "4", sre.CATEGORY_WORD: "w", sre.CATEGORY_SPACE: " "}
        if items[0] == (sre.NEGATE, None):
            return "a"
        op, arg = items[0]
        return chr(arg) if op is sre.LITERAL else chr(arg[0]) if op is sre.RANGE else kinds[arg]

    return walk(sre_parser.parse(pattern.replace("(?i)", "")))


def brute(lines):
    by_language = {}
    for r in LIVE:
        by_language.setdefault(r.language, []).append((r, COMPILED[r.rule_id]))
    found = set()
    for no, language, line in lines:
        for r, pattern in by_language[language]:
            hit = pattern.search(line)
            if hit:
                found.add((no, r.rule_id, hit.group(0), hit.start(), hit.end()))
    return found


def searched(spark, lines):
    df = spark.createDataFrame([("p", "f", lang, no, line) for no, lang, line in lines], "project_id string, path string, language string, line_no bigint, line string")
    rows = M.with_positions(M.match_lines(df)).select("line_no", "rule_id", "matched_text", "column_start", "column_end").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_rule_table():
    assert len(RULES) == 2397
    assert sum(r.dead for r in RULES if r.language != "typescript") == 28
    counts = {}
    for r in RULES:
        counts.setdefault(r.gate, {}).setdefault(r.language, 0)
        counts[r.gate][r.language] += 1
    assert counts["avoid_logging_secrets"] == {"java": 331, "python": 438, "javascript": 331, "typescript": 331, "csharp": 331, "dotnet": 10}
    assert counts["automated_tests"] == {"java": 22, "python": 18, "javascript": 22, "typescript": 22, "csharp": 20}
    assert len({r.rule_id for r in RULES}) == len(RULES)


def test_every_rule_has_a_line_it_finds(spark):
    lines = []
    for i, r in enumerate(LIVE):
        text = sample(r.pattern)
        assert COMPILED[r.rule_id].search(text), r.rule_id
        lines.append((i, r.language, text))
    want = brute(lines)
    assert {rule for _, rule, *_ in want} == {r.rule_id for r in LIVE}
    assert searched(spark, lines) == want


def test_guards_are_implied():
    for r in LIVE:
        low = sample(r.pattern).lower()
        for run in literal_runs(r.pattern):
            assert run in low, (r.rule_id, run)


PIECES = (
    "logger.info( logger.error( print( log( logging.warn( console.log( System.out.println( _logger.LogError( Console.Write( ) ) ( \" ' { } "
    "password token api-key api_key user_id name pin ſecret toKen pıN tİmeout timeout = 30 request response job create delete @Test @Mock "
    "RateLimiter circuit breaker retry( setTimeout( 404 return status error é 😀 , : . = # // tracé auth SECRET Key"
).split(" ") + ["\t", "  ", "\r", " "]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines(spark, seed):
    rnd = random.Random(seed)
    languages = ["python", "java", "javascript", "typescript", "csharp", "dotnet"]
    lines = [
        (i, rnd.choice(languages), rnd.choice(["", " "]).join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))))
        for i in range(1500)
    ]
    assert searched(spark, lines) == brute(lines)


def test_own_rules(spark):
    rules = [Rule("mine", "python", 0, r"foo\d+"), Rule("mine", "go", 0, r"^\s*\w+$"), Rule("pair", "python", 1, "", r"say\s*\(", "Word")]
    rows = [("python", "x foo12 foo3"), ("go", "  word "), ("go", "  word"), ("python", "say (a word b) c)")]
    df = spark.createDataFrame([("p", "f", lang, i, t) for i, (lang, t) in enumerate(rows)], "project_id string, path string, language string, line_no bigint, line string")
    got = {(r.line_no, r.rule_id, r.matched_text) for r in M.match_lines(df, rules).collect()}
    assert got == {(0, "mine:python:000", "foo12"), (2, "mine:go:000", "  word"), (3, "pair:python:001", "say (a word b) c)")}
    with pytest.raises(ValueError):
        M.match_lines(df, [Rule("mine", "python", 0, "a*")])
