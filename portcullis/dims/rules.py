"""The search rules as rows. Users extend the engine by appending ``Rule`` rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as sre, _parser as sre_parser

from . import hits
from .gates import GATES, SECRETS_GATE
from .languages import LANGUAGES
from .pattern_text import PACKS
from .secret_words import BASIC, CALLS, RULE_FORM, WORDS

# A rule table is read on the driver and shipped inside the plan, so its size is checked.
MAX_RULES = 50_000


def literal_runs(pattern, fold=str.lower):
    """ASCII texts that every match of ``pattern`` must contain, in order, lower-cased unless ``fold`` says otherwise.

    Anything optional, alternative or variable ends a run, so each run is a necessary condition.
    """
    runs, current = [], []

    def close():
        if current:
            runs.append(fold("".join(current)))
            current.clear()

    def walk(parsed):
        for op, arg in parsed:
            if op is sre.LITERAL and arg < 128:
                current.append(chr(arg))
            elif op is sre.SUBPATTERN:
                close()
                walk(arg[3])
                close()
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                close()
                walk(arg[2])
                close()
            elif op is sre.AT:
                continue
            else:
                close()

    walk(sre_parser.parse(pattern.replace("(?i)", "")))
    close()
    return runs


def depends_on_surroundings(pattern):
    """True if a match can depend on text outside itself (anchors, word borders, look-around)."""

    def walk(parsed):
        for op, arg in parsed:
            if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                return True
            parts = []
            if op is sre.SUBPATTERN:
                parts = [arg[3]]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                parts = [arg[2]]
            elif op is sre.BRANCH:
                parts = arg[1]
            if any(walk(p) for p in parts):
                return True
        return False

    return walk(sre_parser.parse(pattern.replace("(?i)", "")))


def _first(table, test, otherwise):
    return next((name for name, words in table if any(test(w) for w in words)), otherwise)


def pattern_type(pattern):
    low = pattern.lower()
    return _first(hits.PATTERN_TYPES, lambda w: w in low, hits.PATTERN_TYPE_ELSE)


def pattern_severity(pattern):
    """The grade the pattern alone gives, or None."""
    low = pattern.lower()
    return _first(hits.SEVERITY_WORDS, lambda w: w in low, None)


def suggested_fix(pattern):
    low = pattern.lower()
    open_to = [(text, words) for text, words, others in hits.FIXES if not any(w in low for w in others)]
    return _first(open_to, lambda w: w in low, hits.FIX_ELSE)


@dataclass(frozen=True)
class Rule:
    gate: str
    language: str
    ord: int
    pattern: str
    # Both set for rules of the form "call, then word inside the brackets".
    call: str | None = None
    word: str | None = None
    rule_id: str = field(default="")
    # Derived
    pattern_type: str = field(default="", compare=False)
    pattern_severity: str | None = field(default=None, compare=False)
    suggested_fix: str = field(default="", compare=False)
    documentation_link: str = field(default="", compare=False)
    dead: bool = field(default=False, compare=False)
    contextual: bool = field(default=False, compare=False)
    anchors: tuple = field(default=(), compare=False)

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        if not self.rule_id:
            put("rule_id", f"{self.gate}:{self.language}:{self.ord:03d}")
        kind = pattern_type(self.pattern)
        put("pattern_type", kind)
        put("pattern_severity", pattern_severity(self.pattern))
        put("suggested_fix", suggested_fix(self.pattern))
        put("documentation_link", hits.DOC_LINKS.get(kind, hits.DOC_LINK_ELSE))
        # A pattern with a line break can never match inside one line.
        put("dead", "\\n" in self.pattern)
        if self.word is None:
            put("contextual", depends_on_surroundings(self.pattern))
            put("anchors", tuple(literal_runs(self.pattern)))

    @property
    def can_match_empty(self):
        return re.search(self.pattern.replace("(?i)", ""), "") is not None


def secret_rules(language):
    """One rule per word and call, then the basic rules."""
    rules, i = [], 0
    for word in WORDS:
        for call in CALLS[language]:
            written = RULE_FORM.format(call=call, word=word.replace("-", "\\-"))
            rules.append(Rule(SECRETS_GATE, language, i, written, call, word))
            i += 1
    for pattern in BASIC:
        rules.append(Rule(SECRETS_GATE, language, i, pattern))
        i += 1
    return rules


def default_rules(gates=None, languages=None):
    """The rule table, optionally for some gates or languages only."""
    rules = []
    for gate in gates or GATES:
        for language in languages or [row["language"] for row in LANGUAGES]:
            if gate == SECRETS_GATE:
                rules += secret_rules(language)
                continue
            text = PACKS[gate].get("javascript" if language == "typescript" else language, "")
            rules += [Rule(gate, language, i, p) for i, p in enumerate(text.strip("\n").split("\n")) if p]
    return rules


def check_rules(rules):
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a rule table may have at most {MAX_RULES}")
    return list(rules)


def rules_from_table(table):
    """Rules from a DataFrame (gate, language, ord, pattern); its size is checked before it is read."""
    rows = table.select("gate", "language", "ord", "pattern").limit(MAX_RULES + 1).collect()
    return check_rules([Rule(r.gate, r.language, r.ord, r.pattern) for r in rows])
