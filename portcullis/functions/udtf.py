"""A table function for SQL users: ``SELECT * FROM documents, LATERAL scan_text(text, 'python')``.

It is a convenience for single texts. Tables are searched with ``operators.matching``, without Python.
"""

import re

from pyspark.sql.functions import udtf

from ..dims.rules import default_rules, literal_runs


@udtf(returnType="gate string, rule_id string, line_no int, column_start int, column_end int, matched_text string")
class ScanText:
    def __init__(self):
        self._rules = {}

    def _of(self, language):
        """The rules of a language in order, and the numbers of those that need a text, by the longest text they need."""
        if language not in self._rules:
            rules, by_guard = [], {}
            for no, r in enumerate(r for r in default_rules(languages=[language]) if not r.dead):
                guards = (r.word.lower(), *literal_runs(r.call)) if r.word else r.anchors
                # A word is rarer in lines than the call around it.
                first = guards[0] if r.word else max(guards, key=len, default="")
                rules.append((r.gate, r.rule_id, guards, re.compile(r.pattern.replace("(?i)", ""), re.IGNORECASE)))
                by_guard.setdefault(first, []).append(no)
            self._rules[language] = rules, list(by_guard.items())
        return self._rules[language]

    def eval(self, text: str, language: str):
        rules, by_guard = self._of(language)
        for line_no, line in enumerate((text or "").split("\n"), 1):
            low = line.lower().replace("\u017f", "s").replace("\u0131", "i").replace("\u0307", "")
            for no in sorted([no for guard, nos in by_guard if guard in low for no in nos]):
                gate, rule_id, guards, pattern = rules[no]
                hit = all(g in low for g in guards) and pattern.search(line)
                if hit:
                    yield gate, rule_id, line_no, hit.start(), hit.end(), hit.group(0)


def register(spark, name="scan_text"):
    spark.udtf.register(name, ScanText)
