"""The table function against every rule by itself."""

import re

from portcullis.dims.rules import default_rules
from portcullis.functions.udtf import ScanText

LINES = [
    'logger.info("login password=" + user_id)', "timeout = 30; opts = { timeout: 30 }", 'console.log("api_key", apikey, token)',
    'LOGGER.ERROR("audİt deleted"); retry(max_retries=3)', "", "nothing of note", "ſentry_sdk; import sentry_sdk", "print(passwd) or print('a')",
]


def rows(text, language):
    return list(ScanText.func().eval(text, language))


def test_hits_of_every_rule_in_order():
    for language in ("python", "java", "javascript", "csharp"):
        expected = []
        for no, line in enumerate(LINES, 1):
            for r in default_rules(languages=[language]):
                hit = None if r.dead else re.search(r.pattern.replace("(?i)", ""), line, re.IGNORECASE)
                if hit:
                    expected.append((r.gate, r.rule_id, no, hit.start(), hit.end(), hit.group(0)))
        assert len(expected) > 5
        assert rows("\n".join(LINES), language) == expected


def test_null_text_has_no_hits():
    assert rows(None, "python") == []


def test_rules_with_the_same_text_are_ruled_out_at_once():
    rules, by_guard = ScanText.func()._of("python")
    assert sorted(no for _, nos in by_guard for no in nos) == list(range(len(rules)))
    assert len(by_guard) * 2 < len(rules)
