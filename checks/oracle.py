"""Independent SQL for the registered queries, for DuckDB.

Every statement starts again from the given tables. Shared steps are written once as table expressions
(``T``) and put in front of a statement as far as it needs them.
"""

import re

from checks.corpora import ANSWER_SQL, TREE_SQL
from portcullis.dims import advice, detail_text as DT, gates as D, hits as H, languages as LG, technologies as TD
from portcullis.dims.pattern_text import PACKS
from portcullis.dims.secret_words import BASIC, CALLS, WORDS

T, ORACLES = {}, {}


def lit(s):
    return "'" + str(s).replace("'", "''") + "'"


def rows(values):
    return ", ".join("(" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in v) + ")" for v in values)


def has(text, words):
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def has_re(text, patterns, flags="(?is)"):
    return "(" + " OR ".join(f"regexp_matches({text}, {lit(flags + p)})" for p in patterns) + ")"


def r6(e):
    return f"round(CAST({e} AS DOUBLE), 6)"


def big(e):
    return f"CAST({e} AS BIGINT)"


def oracle(name, sql):
    """Registers a statement with the table expressions it (and they) refer to."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for t in T:
            if t not in needed and re.search(rf"\b{t}\b", text):
                needed.add(t)
                todo.append(T[t])
    ctes = ",\n".join(f"{t} AS MATERIALIZED (\n{T[t]}\n)" for t in T if t in needed)
    ORACLES[name] = f"WITH {ctes}\n{sql}" if ctes else sql


LF = "chr(10)"
SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(e):
    return f"regexp_replace({e}, '^{SP}+|{SP}+$', '', 'g')"


# ---------------------------------------------------------------- corpora

T["c1_events"] = """
SELECT event_id, user_id, event_type, CAST(event_id % 11 AS INT) AS k, CAST(user_id % 8 AS INT) AS project_no,
  CASE user_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' ELSE 'csharp' END AS language,
  CASE user_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' ELSE '.cs' END AS ext,
  CASE user_id % 7 WHEN 0 THEN 'service' WHEN 1 THEN 'controller' WHEN 2 THEN 'client' WHEN 3 THEN 'test' WHEN 4 THEN 'worker' WHEN 5 THEN 'view' ELSE 'util' END AS role
FROM events"""
T["c1_body"] = """
SELECT concat('proj', project_no) AS project_id, concat('src/', role, '/', role, '_', user_id, ext) AS path, language, role, user_id,
  CAST(2 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS line_no,
  CASE
    WHEN k = 10 THEN ''
    WHEN event_type = 'error' THEN CASE language WHEN 'python' THEN concat('    logger.error("request failed", exc_info=True)  # ', k)
      WHEN 'java' THEN '    logger.error("audit {} delete failed", id);' WHEN 'csharp' THEN '    _logger.LogError("Order {Id} failed", id);'
      ELSE '    console.error("request failed", err);' END
    WHEN event_type = 'click' AND k < 4 THEN concat('    timeout = ', k, '0; opts = { timeout: 30 }')
    WHEN event_type = 'click' AND k < 8 THEN '    correlation_id = str(uuid.uuid4()); requestId = correlation_id'
    WHEN event_type = 'click' THEN '    # TODO @retry(max_retries=3) RetryPolicy with exponential backoff'
    WHEN event_type = 'view' AND k < 5 THEN concat('    return status_code=', CASE k WHEN 1 THEN '404' WHEN 2 THEN '500' ELSE '200' END, '; res.status(404); return NotFound();')
    WHEN event_type = 'view' THEN CASE language WHEN 'csharp' THEN '    _logger.LogInformation("request Delete received at endpoint")' ELSE '    logger.info("request received at endpoint")' END
    WHEN event_type = 'signup' AND k < 3 THEN '    logger.info("login password=" + password)'
    WHEN event_type = 'signup' AND k < 6 THEN '    console.log("token", token)'
    WHEN event_type = 'signup' THEN '    assert result; expect(result).toBe(1); assertTrue(result); Assert.True(result)'
    WHEN k < 3 THEN '    breaker = CircuitBreaker(failure_threshold=5, fallback=x); CircuitBreaker.of(x)'
    WHEN k < 6 THEN '    limiter = RateLimiter(rate_limit=10); throttle(1); Semaphore(3); SemaphoreSlim(2)'
    WHEN k = 6 THEN CASE language WHEN 'csharp' THEN '    _logger.LogInformation("job started")' ELSE '    logger.info("job started")' END
    WHEN k = 7 THEN CASE language WHEN 'python' THEN 'import sentry_sdk' WHEN 'java' THEN 'import io.sentry.Sentry;' WHEN 'csharp' THEN 'using Sentry;' ELSE 'import * as S from "@sentry/browser";' END
    WHEN k = 8 THEN CASE language WHEN 'python' THEN '@app.errorhandler(404)' WHEN 'java' THEN '@ExceptionHandler' WHEN 'csharp' THEN '[ExceptionFilter]'
      ELSE '    window.onerror = report; const [error, setError] = useState("error")' END
    WHEN language = 'python' THEN '    log = structlog.get_logger()'
    WHEN language = 'java' THEN '    MDC.put("correlationId", id);'
    WHEN language = 'csharp' THEN '    ILogger<Order> log;'
    ELSE '    logger.info({ id: 1 })' END AS line
FROM c1_events"""
T["c1_heads"] = """
SELECT DISTINCT project_id, path, language, role, user_id,
  CASE language WHEN 'python' THEN concat('def ', CASE WHEN user_id % 3 = 0 THEN 'main' ELSE 'test_' END, role, '(self):')
    WHEN 'java' THEN concat('public void ', role, 'Api(') WHEN 'csharp' THEN concat('public class ', role)
    WHEN 'javascript' THEN concat('function ', role, 'Main(') ELSE concat('export class ', role) END AS line
FROM c1_body"""
T["c1"] = """
SELECT project_id, path, language, line_no, line FROM c1_body
UNION ALL SELECT project_id, path, language, CAST(2 AS BIGINT), line FROM c1_heads
UNION ALL SELECT project_id, path, language, CAST(1 AS BIGINT), concat('# generated ', role) FROM c1_heads"""
T["c1_texts"] = f"SELECT project_id, path, language, string_agg(line, {LF} ORDER BY line_no) AS content FROM c1 GROUP BY ALL"

SUFFIX = r"regexp_extract({0}, '^(?s:.+)(\.[^.]+)$', 1)"
_tree = TREE_SQL.replace("app'", "app'")
T["tree0"] = _tree
T["tree"] = f"SELECT project_id, path, file_name, size, modified, content, {SUFFIX.format('file_name')} AS ext FROM tree0"
T["docs"] = """
SELECT source AS project_id, concat(source, '/', doc_id) AS path, CAST(doc_id AS VARCHAR) AS file_name, strlen(text) AS size, text AS content FROM documents"""
T["page_parts"] = """
SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1) AS route FROM pages"""
T["page_files"] = """
SELECT host AS project_id, concat(route, CASE WHEN contains(route, '.') THEN '' ELSE '.p' END, '#', page_id) AS path,
  strlen(html) AS size, html AS content FROM page_parts"""
T["texts0"] = """
SELECT project_id, path, size, content FROM docs UNION ALL SELECT project_id, path, size, content FROM page_files"""
T["texts"] = f"""
SELECT *, {SUFFIX.format('file_name')} AS ext FROM (SELECT *, list_last(string_split(path, '/')) AS file_name FROM texts0)"""

KNOWN = "CASE lower(ext) " + " ".join(
    f"WHEN '{s}' THEN '{row['language']}'" for row in LG.LANGUAGES for s in row["suffixes"]
) + " END"

# ---------------------------------------------------------------- rules and hits

T["pack_rules"] = (
    "SELECT gate, unnest(CASE WHEN lang = 'javascript' THEN ['javascript', 'typescript'] ELSE [lang] END) AS language, ord, pattern FROM (VALUES "
    + rows(
        (gate, lang, i, p)
        for gate, packs in PACKS.items()
        for lang, text in packs.items()
        for i, p in enumerate(text.strip("\n").split("\n"))
    )
    + ") v(gate, lang, ord, pattern)"
)
T["secret_calls"] = "SELECT * FROM (VALUES " + rows(
    (lang, i, c) for lang, cs in CALLS.items() for i, c in enumerate(cs)
) + ") v(language, call_no, call)"
T["secret_list"] = "SELECT * FROM (VALUES " + rows((i, w.replace("-", "\\-")) for i, w in enumerate(WORDS)) + ") v(word_no, word)"
T["call_counts"] = "SELECT language, count(*) AS calls FROM secret_calls GROUP BY 1"
T["secret_rules"] = (
    "SELECT 'avoid_logging_secrets' AS gate, c.language, word_no * calls + call_no AS ord, "
    "concat(call, '[^)]*(?i).*', word, '([_\\-]?[a-z0-9]*)?.*[^)]*\\)') AS pattern FROM secret_calls c JOIN call_counts n USING (language) CROSS JOIN secret_list "
    "UNION ALL SELECT 'avoid_logging_secrets', l.language, coalesce(calls, 0) * "
    f"{len(WORDS)} + b.ord, b.pattern FROM (VALUES ('python'), ('java'), ('javascript'), ('typescript'), ('csharp'), ('dotnet')) l(language) "
    "LEFT JOIN call_counts USING (language) CROSS JOIN (VALUES " + rows(enumerate(BASIC)) + ") b(ord, pattern)"
)
T["all_rules"] = """
SELECT gate, language, CAST(ord AS INT) AS ord, pattern, concat(gate, ':', language, ':', lpad(CAST(CAST(ord AS INT) AS VARCHAR), 3, '0')) AS rule_id,
  lower(pattern) AS plow
FROM (SELECT * FROM pack_rules UNION ALL SELECT * FROM secret_rules)"""


def _chain(text, table, otherwise, quote=lit):
    return "CASE " + " ".join(f"WHEN {has(text, ws)} THEN {quote(name)}" for name, ws in table) + f" ELSE {quote(otherwise)} END"


T["typed_rules"] = f"""
SELECT *, {_chain('plow', H.PATTERN_TYPES, H.PATTERN_TYPE_ELSE)} AS pattern_type,
  CASE WHEN contains(plow, 'password') OR contains(plow, 'secret') THEN {lit(H.FIXES[0][0])}
    WHEN contains(plow, 'log') AND NOT contains(plow, 'error') THEN {lit(H.FIXES[1][0])}
    WHEN contains(plow, 'try') OR contains(plow, 'catch') THEN {lit(H.FIXES[2][0])}
    WHEN contains(plow, 'todo') OR contains(plow, 'fixme') THEN {lit(H.FIXES[3][0])} ELSE {lit(H.FIX_ELSE)} END AS suggested_fix
FROM all_rules"""
T["line_kinds"] = "SELECT DISTINCT language, line FROM c1"
T["kind_hits"] = r"""
SELECT l.line, r.*, regexp_extract(l.line, '(?is)' || r.pattern, 0) AS matched_text,
  length(regexp_extract(l.line, '(?is)^(.*?)(?:' || r.pattern || ')', 1)) AS column_start
FROM line_kinds l JOIN typed_rules r USING (language)
WHERE regexp_matches(l.line, '(?is)' || r.pattern)"""


def _sev():
    return "CASE " + " ".join(
        f"WHEN {has('plow', ws)} OR {has('lower(matched_text)', ws)} THEN '{g}'" for g, ws in H.SEVERITY_WORDS
    ) + " ELSE 'MEDIUM' END"


def _quotes(q):
    b = "substr(line, 1, column_start)"
    e = lit("\\" + q)
    return f"((length({b}) - length(replace({b}, {lit(q)}, ''))) - (length({b}) - length(replace({b}, {e}, ''))) // 2) % 2 = 1"


T["kind_described"] = f"""
SELECT *, column_start + length(matched_text) AS column_end, {strip('line')} AS full_line, length(line) AS line_length,
  length(line) - length(regexp_replace(line, '^{SP}+', '')) AS indentation_level,
  regexp_matches({strip('line')}, '^(#|//|/\\*|\\*)') AS is_comment,
  ({_quotes("'")} OR {_quotes('"')}) AS is_string_literal, {_sev()} AS severity,
  CASE WHEN contains(lower(matched_text), 'structured') THEN concat(pattern_type, '_structured') WHEN contains(lower(matched_text), 'async') THEN concat(pattern_type, '_async')
    WHEN contains(lower(matched_text), 'error') THEN concat(pattern_type, '_error') ELSE pattern_type END AS category,
  CASE pattern_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in H.DOC_LINKS.items())} ELSE '{H.DOC_LINK_ELSE}' END AS documentation_link
FROM kind_hits"""
T["hits"] = "SELECT c.project_id, c.path, c.line_no, k.* FROM c1 c JOIN kind_described k ON c.language = k.language AND c.line = k.line"

ORIGINAL_HEADERS = {
    "python": LG.HEADER_PATTERNS["python"],
    "javascript": LG.HEADER_PATTERNS["javascript"],
    "typescript": LG.HEADER_PATTERNS["typescript"],
    "java": [
        r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)*(\w+)\s*\(",
        r"^\s*(?:public|private|protected)?\s*class\s+(\w+)",
    ],
    "csharp": [
        r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:\w+\s+)*(\w+)\s*\(",
        r"^\s*(?:public|private|protected|internal)?\s*class\s+(\w+)",
    ],
}
T["headers"] = "SELECT * FROM (SELECT project_id, path, line_no, full_line, CASE language " + " ".join(
    f"WHEN '{lang}' THEN coalesce(" + ", ".join(f"nullif(regexp_extract(full_line, {lit(p)}, 1), '')" for p in ps) + ")"
    for lang, ps in ORIGINAL_HEADERS.items()
) + f" END AS name FROM (SELECT *, {strip('line')} AS full_line FROM c1) WHERE line_no >= 2) WHERE name IS NOT NULL"
T["line_functions"] = """
SELECT c.project_id, c.path, c.line_no, h.name, h.line_no AS header_no, h.full_line AS signature
FROM c1 c LEFT JOIN headers h ON c.project_id = h.project_id AND c.path = h.path AND h.line_no BETWEEN c.line_no - 48 AND c.line_no
QUALIFY row_number() OVER (PARTITION BY c.project_id, c.path, c.line_no ORDER BY h.line_no DESC NULLS LAST) = 1"""
T["named"] = f"""
SELECT h.*, coalesce(f.name, 'unknown') AS function_name,
  CAST(greatest(1, least(10, CASE severity WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 ELSE 2 END
   + CASE WHEN {has("lower(coalesce(f.name, 'unknown'))", H.RAISING_NAMES)} THEN 2 ELSE 0 END
   - CASE WHEN {has("lower(coalesce(f.name, 'unknown'))", H.LOWERING_NAMES)} THEN 1 ELSE 0 END)) AS BIGINT) AS priority
FROM hits h JOIN line_functions f USING (project_id, path, line_no)"""

# ---------------------------------------------------------------- gates

T["file_loc"] = f"""
SELECT project_id, path, language, count(*) FILTER (WHERE {strip('line')} <> '') AS loc FROM c1 GROUP BY ALL"""


def kw(words):
    return f"count(*) FILTER (WHERE {has('lower(path)', words.split())})"


def stats_sql(source, more=""):
    return f"""
SELECT project_id, language, count(*) AS files, {big('sum(loc)')} AS loc,
  {kw('service controller handler manager')} AS k1, {kw('service controller handler manager repository dao model entity')} AS k3,
  {kw('controller handler router middleware api web http')} AS k4, {kw('controller handler router api endpoint resource')} AS k5,
  {kw('job task worker scheduler cron background queue')} AS k6, {kw('service manager')} AS k6b,
  {kw('view template component page ui frontend web controller')} AS k7, {kw('client service api http rest repository dao connector')} AS k8,
  {kw('client service api http rest repository dao connector network')} AS k9, {kw('controller handler router api endpoint resource middleware')} AS k10,
  {kw('client service api connector integration external remote')} AS k11, {kw('service controller handler manager repository dao api web')} AS k12,
  {kw('controller handler router api endpoint resource web')} AS k13,
  count(*) FILTER (WHERE NOT {has('lower(path)', ['test', 'spec', '__tests__', 'tests'])}) AS k15
{more}FROM {source} GROUP BY ALL"""


T["stats"] = stats_sql("file_loc")
EXPECT = {
    "structured_logs": "greatest(files // 2, 1) + loc // 100 + 3 * k1",
    "avoid_logging_secrets": "0",
    "audit_trail": "greatest(2 * k3, 5)",
    "correlation_id": "greatest(k4, 3)",
    "log_api_calls": "greatest(2 * k5, 5)",
    "log_background_jobs": "greatest(2 * CASE WHEN k6 = 0 THEN greatest(k6b // 3, 1) ELSE k6 END, 3)",
    "ui_errors": "greatest(k7 // 2, 1)",
    "retry_logic": "greatest(2 * k8, files // 3)",
    "timeouts": "greatest(2 * k9, files // 4)",
    "throttling": "greatest(k10 // 3, 1)",
    "circuit_breakers": "greatest(k11 // 2, 1)",
    "error_logs": "greatest(2 * k12, files // 3)",
    "http_codes": "greatest(3 * k13, 5)",
    "ui_error_tools": "1",
    "automated_tests": "greatest(2 * k15, files // 2)",
}


def expect_sql(stats):
    return " UNION ALL ".join(f"SELECT project_id, language, '{g}' AS gate, {big(e)} AS expected FROM {stats}" for g, e in EXPECT.items())


T["expect"] = expect_sql("stats")


def cnt(words, each, cap):
    return f"least(count(*) FILTER (WHERE {has('low', words)}) * {each}, {cap})"


def cntre(patterns, each, cap):
    return f"least(count(*) FILTER (WHERE {has_re('low', patterns, '')}) * {each}, {cap})"


def tool(w):
    return f"CASE WHEN count(*) FILTER (WHERE contains(low, '{w}')) > 0 THEN 20 ELSE 0 END"


BONUS = {
    "structured_logs": cnt(["json"], 5, 15) + " + " + cnt(["correlation", "request_id", "user_id", "trace_id", "session"], 3, 10)
    + " + CASE WHEN count(DISTINCT path) >= 3 THEN least(count(DISTINCT path) * 2, 10) ELSE 0 END + " + cnt(["error", "warn", "info", "debug"], 2, 10),
    "avoid_logging_secrets": "0",
    "audit_trail": cnt("create update delete login logout access".split(), 5, 20) + " + " + cnt("user admin actor".split(), 3, 15),
    "correlation_id": cnt("uuid guid random".split(), 5, 15) + " + " + cnt("x-correlation-id x-request-id header".split(), 5, 15),
    "log_api_calls": cnt(["request"], 3, 10) + " + " + cnt(["response"], 3, 10) + " + " + cnt("endpoint route path".split(), 2, 10),
    "log_background_jobs": cnt("start complete failed retry".split(), 3, 15) + " + " + cnt("error exception failed".split(), 2, 10),
    "ui_errors": cnt("errorboundary componentdidcatch error.*boundary".split(), 5, 15) + " + " + cnt("user.*friendly message alert notification".split(), 3, 10),
    "retry_logic": cnt("@retry @retryable retry_template".split(), 5, 15) + " + " + cnt("backoff exponential linear delay".split(), 3, 10),
    "timeouts": cnt("connect connection".split(), 3, 10) + " + " + cnt("read response socket".split(), 3, 10),
    "throttling": cnt("@ decorator middleware".split(), 5, 15) + " + " + cnt("bucket4j resilience4j slowapi express-rate-limit".split(), 3, 10),
    "circuit_breakers": cnt("resilience4j hystrix polly opossum pybreaker".split(), 5, 15) + " + " + cnt("threshold timeout recovery fallback".split(), 2, 10),
    "error_logs": cnt("exception error catch try".split(), 3, 15) + " + " + cnt("traceback stacktrace stack_trace tostring".split(), 2, 10)
    + " + " + cnt("json structured context".split(), 2, 10),
    "http_codes": cntre([r"2\d{2}", "ok", "created", "accepted"], 2, 10) + " + " + cntre([r"4\d{2}", "badrequest", "unauthorized", "notfound"], 2, 10)
    + " + " + cntre([r"5\d{2}", "internalservererror", "badgateway"], 2, 10),
    "ui_error_tools": " + ".join(map(tool, "sentry rollbar bugsnag airbrake".split())),
    "automated_tests": cnt(["@test", "describe", "it(", "def test_", "assert"], 2, 15) + " + " + cnt("mock stub spy fake @mock mockito".split(), 3, 10)
    + " + " + cnt("assert expect should verify toequal tobe".split(), 1, 10),
}
T["low_hits"] = "SELECT *, lower(matched_text) AS low FROM hits"


def found_sql(low_hits):
    return " UNION ALL ".join(
        f"SELECT project_id, language, '{g}' AS gate, count(*) AS found, {b} AS bonus FROM {low_hits} WHERE gate = '{g}' GROUP BY project_id, language"
        for g, b in BONUS.items()
    )


def results_sql(expect, found):
    return f"""
SELECT e.project_id, e.gate, e.language, e.expected, coalesce(f.found, 0) AS found, CAST(coalesce(f.bonus, 0) AS DOUBLE) AS bonus,
  CASE WHEN e.gate = 'avoid_logging_secrets' THEN CAST(greatest(0, 100 - 10 * coalesce(f.found, 0)) AS DOUBLE)
    WHEN e.expected = 0 THEN CASE WHEN coalesce(f.found, 0) = 0 THEN 100.0 ELSE 50.0 END
    ELSE least(least(CAST(coalesce(f.found, 0) AS DOUBLE) / e.expected, 1.0) * 100 + coalesce(f.bonus, 0), 100.0) END AS quality
FROM {expect} e LEFT JOIN {found} f USING (project_id, language, gate)"""


T["found_per_gate"] = found_sql("low_hits")
T["lang_results"] = results_sql("expect", "found_per_gate")
T["gate_dim"] = "SELECT * FROM (VALUES " + rows(
    (g, i, D.WEIGHTS[g], D.CATEGORY_OF[g], D.DISPLAY_NAMES[g]) for i, g in enumerate(D.GATES)
) + ") v(gate, gate_ord, weight, gate_category, display_name)"
LANG_ORD = "CASE language WHEN 'java' THEN 0 WHEN 'python' THEN 1 WHEN 'javascript' THEN 2 WHEN 'typescript' THEN 3 WHEN 'csharp' THEN 4 ELSE 5 END"


def mean(value, order, kept="true"):
    """Mean with the values summed in a fixed order."""
    return f"list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST({value} AS DOUBLE) ORDER BY {order}) FILTER (WHERE {kept})), lambda a, b: a + b) / nullif(count(*) FILTER (WHERE {kept}), 0)"


def combined_sql(results):
    return f"""
SELECT project_id, gate, {big('sum(expected)')} AS expected, {big('sum(found)')} AS found, {mean('quality', LANG_ORD)} AS quality_score FROM {results} GROUP BY project_id, gate"""


def covered_sql(combined):
    return f"""
SELECT *, CASE WHEN expected > 0 THEN CAST(found AS DOUBLE) / expected * 100 WHEN found = 0 THEN 100.0 WHEN gate = 'avoid_logging_secrets' THEN 0.0
    ELSE CAST(greatest(0, 100 - found * 10) AS DOUBLE) END AS coverage,
  CASE WHEN quality_score >= 90 THEN 1.0 WHEN quality_score >= 80 THEN 0.9 WHEN quality_score >= 70 THEN 0.8 WHEN quality_score >= 60 THEN 0.6 ELSE 0.4 END AS multiplier
FROM {combined} JOIN gate_dim USING (gate)"""


FINAL = "least((coverage * CAST(0.7 AS DOUBLE) + quality_score * CAST(0.3 AS DOUBLE)) * weight * multiplier, 100.0)"


def scored_sql(covered):
    return f"""
SELECT *, CASE WHEN gate = 'avoid_logging_secrets' AND found > 0 THEN 'FAIL' WHEN final_score >= 80 THEN 'PASS' WHEN final_score >= 60 THEN 'WARNING' ELSE 'FAIL' END AS status
FROM (SELECT *, CAST({FINAL} AS DOUBLE) AS final_score FROM {covered})"""


def applied_sql(scored, flags):
    """Scores of gates that apply; ``flags`` is joined for has_ui and has_jobs."""
    return f"""
SELECT s.project_id, s.gate, s.gate_ord, s.weight, applicable, CASE WHEN applicable THEN expected ELSE 0 END AS expected, CASE WHEN applicable THEN found ELSE 0 END AS found,
  CASE WHEN applicable THEN least(greatest(coverage, 0.0), 100.0) ELSE 0.0 END AS coverage, CASE WHEN applicable THEN quality_score ELSE 0.0 END AS quality_score,
  CASE WHEN applicable THEN final_score ELSE 0.0 END AS final_score, CASE WHEN applicable THEN status ELSE 'NOT_APPLICABLE' END AS status
FROM (SELECT s.*, CASE WHEN gate IN ('ui_errors', 'ui_error_tools') THEN has_ui WHEN gate = 'log_background_jobs' THEN has_jobs ELSE true END AS applicable
      FROM {scored} s {flags}) s"""


T["combined"] = combined_sql("lang_results")
T["covered"] = covered_sql("combined")
T["scored"] = scored_sql("covered")


def ui_text_sql():
    tags = " + ".join(f"contains(lower(content), {lit(t)})::INT" for t in TD.HTML_TAGS)
    return f"""(regexp_matches(lower(path), '({"|".join(s.replace(".", "[.]") for s in TD.UI_SUFFIXES)})$')
  OR {has_re('content', TD.UI_PATTERNS, '(?im)')} OR ({has_re('content', TD.HTML_PATTERNS, '(?im)')} AND {tags} >= 2)
  OR ({has_re('content', TD.SCRIPT_PATTERNS, '(?im)')} AND {has('lower(content)', TD.BROWSER_WORDS)} AND NOT {has('lower(content)', TD.SERVER_WORDS)}))"""


def ui_tree_sql():
    return f"""({" OR ".join(f"starts_with(path, '{d}/')" for d in TD.UI_DIRS)}
  OR (path = 'package.json' AND {has('lower(content)', [q + p + q for p in TD.UI_PACKAGES for q in ('"', "'")])}))"""


def ui_sql(source):
    return f"SELECT project_id, bool_or({ui_text_sql()} OR {ui_tree_sql()}) AS has_ui FROM {source} GROUP BY 1"


def jobs_sql(source):
    return f"SELECT project_id, bool_or({has_re('content', TD.BACKGROUND_PATTERNS, '(?im)')}) AS has_jobs FROM {source} GROUP BY 1"


T["c1_ui"] = ui_sql("c1_texts")
T["c1_jobs"] = jobs_sql("c1_texts")
T["final"] = applied_sql("scored", "JOIN c1_ui USING (project_id) JOIN c1_jobs USING (project_id)")


def overall_sql(final):
    return f"""
SELECT project_id, coalesce({mean('final_score', 'gate_ord', "status IN ('PASS', 'WARNING', 'FAIL', 'FAILED')")}, 0.0) AS overall_score FROM {final} GROUP BY 1"""


T["overall"] = overall_sql("final")
T["findings"] = f"""
SELECT project_id, list_filter([CASE WHEN nf > 5 THEN concat('Multiple gate failures detected (', nf, ' gates failed)') END, CASE WHEN overall_score < 50 THEN {lit(D.LOW_SCORE_ISSUE)} END,
    CASE WHEN leak THEN {lit(D.SECRETS_ISSUE)} END], lambda x: x IS NOT NULL) AS critical_issues,
  list_filter(list_concat(list_concat([CASE WHEN nf > 5 THEN {lit(D.MANY_FAILURES_ADVICE)} END], list_transform(firsts[1:3], lambda g: CASE g
      WHEN 'structured_logs' THEN {lit(D.FAILED_GATE_ADVICE['structured_logs'])} WHEN 'retry_logic' THEN {lit(D.FAILED_GATE_ADVICE['retry_logic'])}
      WHEN 'error_logs' THEN {lit(D.FAILED_GATE_ADVICE['error_logs'])} END)),
    [CASE WHEN overall_score < 50 THEN {lit(D.LOW_SCORE_ADVICE)} END, CASE WHEN leak THEN {lit(D.SECRETS_ADVICE)} END]), lambda x: x IS NOT NULL) AS recommendations
FROM (SELECT project_id, count(*) FILTER (WHERE status = 'FAIL') AS nf, bool_or(status = 'FAIL' AND gate = 'avoid_logging_secrets') AS leak,
        list(gate ORDER BY gate_ord) FILTER (WHERE status = 'FAIL') AS firsts FROM final GROUP BY 1) JOIN overall USING (project_id)"""
T["report_gates"] = """
SELECT project_id, gate, found, coverage, final_score, CASE WHEN status IN ('WARNING', 'NOT_APPLICABLE') THEN status WHEN final_score >= 80 THEN 'PASS' WHEN final_score >= 60 THEN 'WARNING' ELSE 'FAIL' END AS status
FROM final"""


def joined(e):
    return f"array_to_string({e}, ' | ')"


# ---------------------------------------------------------------- statements: sources, filters

oracle("s2_files_from_table", f"SELECT project_id, path, file_name, ext, {big('size')} AS size, {KNOWN} AS language FROM texts")
oracle("s3_explode_lines", f"""
SELECT project_id, path, CAST(i AS BIGINT) AS line_no, ls[i] AS line FROM (SELECT project_id, path, string_split(content, {LF}) AS ls FROM texts), unnest(range(1, len(ls) + 1)) u(i)""")
T["export_names"] = "SELECT * FROM (VALUES " + rows(D.EXPORT_NAMES.items()) + ") v(gate, export_name)"
oracle("s5_sarif_results", f"""
SELECT project_id, concat(export_name, '_', category) AS rule_id, lower(severity) AS level, suggested_fix AS message, path AS uri, line_no AS start_line, {big('column_start')} AS start_column,
  {big('column_end')} AS end_column, priority, pattern, function_name AS function, documentation_link AS documentation FROM named JOIN export_names USING (gate)""")
oracle("s6_latest_reports", f"""
SELECT concat('proj', user_id % 8) AS project_name, concat('report_', strftime(ts, '%Y%m%d_%H%M%S'), '.json') AS file_name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS scan_date, {r6('max(value)')} AS overall_score
FROM events GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY project_name ORDER BY file_name DESC) = 1""")


def manifest(lang):
    exact = [m for m in LG.MANIFESTS[lang] if "*" not in m]
    glob = [m for m in LG.MANIFESTS[lang] if "*" in m]
    t = f"file_name IN ({', '.join(map(lit, exact))})"
    return "(" + " OR ".join([t] + [f"regexp_matches(file_name, {lit('^' + g.replace('*', '.*'))})" for g in glob]) + ")"


oracle("s7_manifest_files", " UNION ALL ".join(f"SELECT project_id, path, file_name, '{lang}' AS language FROM tree WHERE {manifest(lang)}" for lang in LG.MANIFESTS))
oracle("p1_exclude_paths", r"""
SELECT project_id, path, size FROM tree WHERE NOT contains(path, 'node_modules') AND NOT regexp_matches(path, '(^|/)[^/]*\.css$') AND NOT regexp_matches(path, '(^|/)docs/[^/]*/README\.md$')""")
oracle("p2_include_paths", """
SELECT project_id, path, size FROM tree WHERE file_name LIKE '%.py' OR file_name LIKE '%.java' OR file_name = 'Dockerfile' OR file_name LIKE 'run.%'""")
oracle("p3_max_file_size", "SELECT project_id, path, size FROM tree WHERE size <= 1048576")
T["pruned_tree"] = f"SELECT * FROM tree WHERE len(list_intersect(string_split(path, '/')[1:-2], [{', '.join(map(lit, LG.SKIPPED_DIRS))}])) = 0"
oracle("p4_prune_dirs", "SELECT project_id, path, size FROM pruned_tree")
oracle("p5_file_columns", """
SELECT project_id, path, list_last(string_split(path, '/')) AS file_name, ext, lower(ext) AS ext_lower FROM tree""")
T["addresses"] = """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN concat('https://github.com/owner', c_custkey, '/repo', c_custkey) WHEN 1 THEN concat('https://github.com/owner', c_custkey, '/repo.git')
    WHEN 2 THEN concat('https://code.GitHub.corp', c_nationkey, '.com/team/project.git/') WHEN 3 THEN 'https://gitlab.com/user/repo' WHEN 4 THEN concat('https://github.com/solo', c_custkey)
    ELSE 'https://github.com/a/b/tree/main?x=1#top' END AS url FROM customer
UNION ALL SELECT page_id, url FROM pages"""
oracle("p6_project_name", r"""
SELECT id, url, regexp_replace(list_last(string_split(rtrim(url, '/'), '/')), '\.git$', '') AS project_name,
  regexp_replace(CASE WHEN url LIKE '%/' THEN 'Repository Scan Results' ELSE list_last(string_split(url, '/')) END, '\.git$', '') AS report_name FROM addresses""")
oracle("p7_classify_repo_url", r"""
SELECT id, url, host, contains(lower(host), 'github') AND len(parts) >= 2 AS is_valid, contains(lower(host), 'github') AND lower(host) <> 'github.com' AS is_enterprise,
  CASE WHEN lower(host) = 'github.com' THEN 'https://api.github.com' ELSE concat('https://', host, '/api/v3') END AS api_base,
  CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner, CASE WHEN len(parts) >= 2 THEN regexp_replace(parts[2], '\.git$', '') END AS repo,
  host LIKE '%github.com' AND route <> '' AND len(parts) = 2 AS is_strict_valid
FROM (SELECT id, url, host, route, string_split(trim(route, '/'), '/') AS parts FROM
  (SELECT id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS route FROM addresses))""")
KEY = "project_id, path, line_no, rule_id"
oracle("p8_high_priority_matches", f"SELECT {KEY}, priority, severity, matched_text FROM named WHERE priority >= 7 AND severity = 'HIGH'")
oracle("p9_applicable_gates", f"SELECT project_id, gate, status, {r6('final_score')} AS final_score FROM final WHERE applicable")

# ---------------------------------------------------------------- languages


def signs(lang, head):
    return " + ".join(f"regexp_matches({head}, {lit(p)})::INT" for p in LG.CONTENT_PATTERNS[lang])


GUESS = "coalesce(" + ", ".join(f"CASE WHEN {signs(lang, 'content')} >= 2 THEN '{lang}' END" for lang in LG.CONTENT_PATTERNS) + ")"
SIGNS = "CASE language " + " ".join(f"WHEN '{lang}' THEN {signs(lang, 'content')}" for lang in LG.CONTENT_PATTERNS) + " ELSE 0 END"
T["any_files"] = "SELECT project_id, path, ext, content FROM tree UNION ALL SELECT project_id, path, ext, content FROM texts"
T["any_classified"] = f"SELECT *, coalesce({KNOWN}, {GUESS}) AS language FROM any_files"
oracle("l1_file_language", "SELECT project_id, path, language FROM any_classified")
oracle("l2_content_score", f"SELECT project_id, language, {big(f'sum({SIGNS})')} AS content_matches FROM c1_texts GROUP BY ALL")
oracle("l3_extension_histogram", "SELECT project_id, lower(ext) AS ext, count(*) AS files FROM tree WHERE ext <> '' GROUP BY ALL")
oracle("l4_config_presence", " UNION ALL ".join(f"SELECT project_id, '{lang}' AS language, bool_or({manifest(lang)}) AS has_config FROM tree GROUP BY 1" for lang in LG.MANIFESTS))
oracle("l5_language_confidence", f"""
SELECT project_id, language, file_count, {big('content_matches')} AS content_matches, {r6('least(least(file_count * 2, 40) + least(content_matches * 3, 40), 100)')} AS confidence
FROM (SELECT project_id, language, count(*) AS file_count, sum({SIGNS}) AS content_matches FROM c1_texts GROUP BY ALL)""")
T["classified"] = f"SELECT *, coalesce({KNOWN}, {GUESS}) AS language FROM tree"
T["scanned"] = f"SELECT *, {SIGNS} AS signs FROM classified WHERE path IN (SELECT path FROM pruned_tree) AND size <= 1048576"
T["language_dim"] = "SELECT * FROM (VALUES " + rows((r["language"], i) for i, r in enumerate(LG.LANGUAGES)) + ") v(language, language_ord)"


def language_stats_sql(scanned):
    return f"""
SELECT p.project_id, d.language, d.language_ord, count(s.language) AS file_count, {big('coalesce(sum(s.signs), 0)')} AS content_matches, any_value(coalesce(c.has_config, false)) AS has_config,
  CAST(least(least(count(s.language) * 2, 40) + least(coalesce(sum(s.signs), 0) * 3, 40) + CASE WHEN any_value(coalesce(c.has_config, false)) THEN 20 ELSE 0 END, 100) AS DOUBLE) AS confidence
FROM (SELECT DISTINCT project_id FROM {scanned}) p CROSS JOIN language_dim d
LEFT JOIN {scanned} s ON s.project_id = p.project_id AND s.language = d.language
LEFT JOIN ({" UNION ALL ".join(f"SELECT project_id, '{lang}' AS language, bool_or({manifest(lang)}) AS has_config FROM {scanned} GROUP BY 1" for lang in LG.MANIFESTS)}) c
  ON c.project_id = p.project_id AND c.language = d.language
GROUP BY 1, 2, 3"""


def detected_sql(stats):
    return f"""
SELECT project_id, language, language_ord, confidence FROM {stats} WHERE confidence >= 30
UNION ALL SELECT project_id, language, language_ord, confidence FROM (SELECT * FROM {stats} WHERE project_id NOT IN (SELECT project_id FROM {stats} WHERE confidence >= 30)
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY file_count DESC, language_ord) = 1) WHERE file_count > 0"""


T["language_stats"] = language_stats_sql("scanned")
oracle("l6_language_statistics", "SELECT project_id, language, file_count, content_matches, has_config, confidence FROM language_stats")
T["detected"] = detected_sql("language_stats")
oracle("l7_detect_languages", "SELECT project_id, language, confidence FROM detected")
oracle("l8_primary_language", """
SELECT project_id, coalesce(first, 'python') AS language FROM (SELECT DISTINCT project_id FROM tree) LEFT JOIN (SELECT project_id, arg_min(language, language_ord) AS first FROM detected GROUP BY 1) USING (project_id)""")

# ---------------------------------------------------------------- the scan of files

T["s1_files"] = "SELECT project_id, path, file_name, ext, size, content FROM tree UNION ALL SELECT project_id, path, file_name, ext, size, content FROM texts"
T["s1_typed"] = f"SELECT *, coalesce({KNOWN}, {GUESS}) AS language FROM s1_files"
T["s1_detecting"] = f"""
SELECT *, {SIGNS} AS signs FROM s1_typed WHERE len(list_intersect(string_split(path, '/')[1:-2], [{', '.join(map(lit, LG.SKIPPED_DIRS))}])) = 0"""
T["s1_language_stats"] = language_stats_sql("s1_detecting")
T["s1_detected"] = detected_sql("s1_language_stats")
T["s1_suffixes"] = "SELECT * FROM (VALUES " + rows((r["language"], x) for r in LG.LANGUAGES for x in r["scan_suffixes"]) + ") v(language, suffix)"
T["s1_globs"] = "SELECT * FROM (VALUES " + rows((r["language"], x) for r in LG.LANGUAGES for x in r["search_suffixes"] or [""]) + ") v(language, suffix)"
T["s1_counted"] = f"""
SELECT project_id, path, content, d.language, {big(f"len(list_filter(string_split(content, {LF}), lambda x: {strip('x')} <> ''))")} AS loc,
  {ui_text_sql()} AS ui, {has_re('content', TD.BACKGROUND_PATTERNS, '(?im)')} AS jobs
FROM s1_files f JOIN s1_suffixes x ON ends_with(f.file_name, x.suffix) JOIN s1_detected d USING (project_id, language)"""
T["s1_stats"] = stats_sql("s1_counted", ", bool_or(ui) AS ui, bool_or(jobs) AS jobs ")
# Every used language has a row, also without files; the expected counts of such a row are 0.
T["s1_every"] = "SELECT project_id, language, s.* EXCLUDE (project_id, language) FROM s1_detected LEFT JOIN s1_stats s USING (project_id, language)"
T["s1_expect"] = f"SELECT project_id, language, gate, CASE WHEN coalesce(s.files, 0) = 0 THEN 0 ELSE expected END AS expected FROM ({expect_sql('s1_every')}) JOIN s1_every s USING (project_id, language)"
T["s1_lines"] = f"""
SELECT project_id, path, d.language, unnest(string_split(content, {LF})) AS line
FROM s1_files f JOIN s1_globs g ON CASE WHEN g.suffix = '' THEN contains(f.file_name, '.') ELSE f.ext = g.suffix END JOIN s1_detected d USING (project_id, language)"""
T["s1_low_hits"] = """
WITH kinds AS (SELECT DISTINCT language, line FROM s1_lines),
found AS (SELECT line, r.language, r.gate, lower(regexp_extract(line, '(?is)' || r.pattern, 0)) AS low FROM kinds JOIN all_rules r USING (language) WHERE regexp_matches(line, '(?is)' || r.pattern))
SELECT project_id, path, language, gate, low FROM s1_lines JOIN found USING (language, line)"""
T["s1_found"] = found_sql("s1_low_hits")
T["s1_results"] = results_sql("s1_expect", "s1_found")
T["s1_combined"] = combined_sql("s1_results")
T["s1_covered"] = covered_sql("s1_combined")
T["s1_scored"] = scored_sql("s1_covered")
T["s1_flags"] = f"""
SELECT project_id, bool_or(coalesce(ui, false)) OR any_value(tree) AS has_ui, bool_or(coalesce(jobs, false)) AS has_jobs
FROM s1_every JOIN (SELECT project_id, bool_or({ui_tree_sql()}) AS tree FROM s1_files GROUP BY 1) USING (project_id) GROUP BY 1"""
T["s1_final"] = applied_sql("s1_scored", "JOIN s1_flags USING (project_id)")
oracle("s1_scan_scores", f"""
SELECT project_id, gate, expected, found, {r6('coverage')} AS coverage, {r6('quality_score')} AS quality_score, {r6('final_score')} AS final_score, status FROM s1_final""")
T["s1_overall"] = overall_sql("s1_final")
oracle("s1_scan_summary", f"""
SELECT project_id, language, total_files, total_lines, {r6('overall_score')} AS overall_score, passed_gates, warning_gates, failed_gates, not_applicable_gates FROM s1_overall
JOIN (SELECT project_id, arg_min(language, language_ord) AS language FROM s1_detected GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, {big('sum(coalesce(files, 0))')} AS total_files, {big('sum(coalesce(loc, 0))')} AS total_lines FROM s1_every GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, count(*) FILTER (WHERE status = 'PASS') AS passed_gates, count(*) FILTER (WHERE status = 'WARNING') AS warning_gates,
        count(*) FILTER (WHERE status IN ('FAIL', 'FAILED')) AS failed_gates, count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable_gates FROM s1_final GROUP BY 1) USING (project_id)""")

# ---------------------------------------------------------------- matching

oracle("m1_match_lines", f"SELECT {KEY}, gate, language FROM hits")
oracle("m2_positions", f"SELECT {KEY}, matched_text, {big('column_start')} AS column_start, {big('column_end')} AS column_end FROM hits")
oracle("m3_line_shape", f"SELECT {KEY}, full_line, {big('line_length')} AS line_length, {big('indentation_level')} AS indentation_level FROM hits")
for _name, _col in [("m4_is_comment", "is_comment"), ("m5_is_string_literal", "is_string_literal"), ("m6_severity", "severity"), ("m7_pattern_type", "pattern_type"),
                    ("m8_category", "category"), ("m9_suggested_fix", "suggested_fix"), ("m10_documentation_link", "documentation_link")]:
    oracle(_name, f"SELECT {KEY}, {_col} FROM hits")
FUNCTION = """coalesce(name, 'unknown') AS function_name, coalesce(header_no, 0) AS function_line, coalesce(signature, '') AS function_signature,
  coalesce(line_no - header_no, 0) AS distance_from_function"""
oracle("m11_function_context", f"SELECT project_id, path, line_no, {FUNCTION} FROM line_functions")
oracle("m12_context_lines", f"""
SELECT project_id, path, line_no, array_to_string(list(line) OVER w, ' | ') AS context_lines, min(line_no) OVER w AS context_start_line, max(line_no) OVER w AS context_end_line
FROM c1 WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
T["all_context"] = """
SELECT project_id, path, line_no, array_to_string(list(line) OVER w, ' | ') AS context_lines, min(line_no) OVER w AS context_start_line, max(line_no) OVER w AS context_end_line
FROM c1 WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""
oracle("m12_hit_context", "SELECT * FROM all_context SEMI JOIN hits USING (project_id, path, line_no)")
T["any_function"] = """
SELECT c.project_id, c.path, c.line_no, h.name, h.line_no AS header_no, h.full_line AS signature
FROM (SELECT DISTINCT project_id, path, line_no FROM hits) c LEFT JOIN headers h ON c.project_id = h.project_id AND c.path = h.path AND h.line_no <= c.line_no
QUALIFY row_number() OVER (PARTITION BY c.project_id, c.path, c.line_no ORDER BY h.line_no DESC NULLS LAST) = 1"""
oracle("m11_function_anywhere", f"SELECT project_id, path, line_no, {FUNCTION} FROM any_function")
oracle("m13_priority", f"SELECT {KEY}, function_name, priority FROM named")
oracle("m14_match_summary", """
SELECT count(*) AS hits, count(*) FILTER (WHERE priority >= 7) AS high_priority, count(*) FILTER (WHERE severity = 'HIGH') AS security_issues,
  count(DISTINCT (project_id, path)) AS files, count(DISTINCT function_name) AS functions FROM named""")

# ---------------------------------------------------------------- joins

oracle("j1_lines_rules", f"SELECT {KEY}, gate FROM hits")
oracle("j2_language_rules", """
SELECT l.project_id, g.gate, l.language, count(r.rule_id) AS rules FROM (SELECT DISTINCT project_id, language FROM (SELECT project_id, """ + KNOWN + """ AS language FROM tree) WHERE language IS NOT NULL) l
CROSS JOIN gate_dim g LEFT JOIN all_rules r ON r.gate = g.gate AND r.language = l.language GROUP BY 1, 2, 3""")
oracle("j3_every_gate", """
SELECT p.project_id, g.gate, count(h.rule_id) AS found FROM (SELECT project_id FROM tree UNION SELECT project_id FROM c1) p CROSS JOIN gate_dim g
LEFT JOIN hits h ON h.project_id = p.project_id AND h.gate = g.gate GROUP BY 1, 2""")
oracle("j4_language_filter", "SELECT project_id, path, language FROM classified c WHERE EXISTS (SELECT 1 FROM detected d WHERE d.project_id = c.project_id AND d.language = c.language)")
oracle("j5_gate_facts", f"SELECT project_id, gate, found, {r6('weight')} AS weight, gate_category, display_name FROM combined JOIN gate_dim USING (gate)")
T["label_rows"] = """
SELECT concat('proj', doc_id % 8) AS project_id, gate, quality, toxic FROM labels JOIN gate_dim ON gate_ord = (doc_id // 8) % 15"""
T["supplied"] = "SELECT project_id, gate, concat('quality ', min(quality)) AS comment FROM label_rows GROUP BY ALL"
oracle("j6_comments", """
SELECT c.project_id, c.gate, coalesce(st.comment, su.comment) AS comment FROM combined c LEFT JOIN supplied su USING (project_id, gate)
LEFT JOIN (SELECT project_id, gate, concat('toxic ', count(*)) AS comment FROM label_rows WHERE toxic = 1 GROUP BY ALL) st USING (project_id, gate)""")
T["saved"] = """
SELECT CAST(user_id AS VARCHAR) AS scan_id, concat('hard_gate_report_', user_id, '.html') AS file_name, count(*) * 40000 AS size, max(ts) AS modified FROM events GROUP BY user_id"""
T["runs"] = """
SELECT CAST(user_id AS VARCHAR) AS scan_id, arg_max(event_type, (ts, event_type)) AS status, max(value) AS score FROM events GROUP BY user_id"""
oracle("j7_report_runs", "SELECT scan_id, file_name, coalesce(status, 'unknown') AS status FROM saved LEFT JOIN runs USING (scan_id)")
oracle("j8_nearest_header", f"SELECT h.project_id, h.path, h.line_no, h.matched_text, {FUNCTION.replace('line_no - ', 'h.line_no - ')} FROM hits h JOIN line_functions f USING (project_id, path, line_no)")
oracle("j9_without_language", """
SELECT project_id, path FROM any_classified a WHERE language IS NULL AND NOT EXISTS (SELECT 1 FROM any_classified b WHERE b.project_id = a.project_id AND b.path = a.path AND b.language IS NOT NULL)""")

# ---------------------------------------------------------------- gates

for _i, _g in enumerate(
    ("structured_logs avoid_logging_secrets audit_trail correlation_id log_api_calls log_background_jobs ui_errors retry_logic timeouts throttling circuit_breakers "
     "error_logs http_codes ui_error_tools automated_tests").split(), 1
):
    oracle(f"g{_i}_{_g}", f"SELECT project_id, gate, language, expected, found, {r6('quality')} AS quality FROM lang_results WHERE gate = '{_g}'")
oracle("g16_quality_score", f"SELECT project_id, gate, language, found, expected, {r6('bonus')} AS bonus, {r6('quality')} AS quality FROM lang_results")
KIND = _chain("low", D.VIOLATION_KINDS, D.VIOLATION_OTHER)
T["leaks"] = f"SELECT *, {KIND} AS violation_kind FROM low_hits WHERE gate = 'avoid_logging_secrets'"
oracle("g17_violation_breakdown", """
SELECT project_id, violation_kind, count(*) AS violations, CASE WHEN count(*) >= 5 THEN 'CRITICAL' WHEN count(*) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS tag FROM leaks GROUP BY 1, 2""")
_kinds = ", ".join(f"count(*) FILTER (WHERE {has('low', ws)}) AS {n}_violations" for n, ws, _ in D.VIOLATION_WEIGHTS)
oracle("g18_violation_severity", f"""
SELECT *, {big(' + '.join(f'{n}_violations * ({w})' for n, _, w in D.VIOLATION_WEIGHTS))} AS severity_score,
  {big(' + '.join(f'({n}_violations > 0)::INT' for n, _, w in D.VIOLATION_WEIGHTS))} AS categories_affected
FROM (SELECT project_id, count(*) AS total_violations, {_kinds} FROM leaks GROUP BY 1)""")
oracle("g19_violation_examples", """
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY ko, kr) AS example_no, violation_kind, path, line_no, substr(matched_text, 1, 60) AS shown
FROM (SELECT *, CASE violation_kind WHEN 'Authentication & Tokens' THEN 0 WHEN 'Credentials & Passwords' THEN 1 ELSE 2 END AS ko,
        row_number() OVER (PARTITION BY project_id, violation_kind ORDER BY language, path, line_no, ord) AS kr
      FROM leaks WHERE violation_kind IN ('Authentication & Tokens', 'Credentials & Passwords', 'API Keys & Service Credentials')) WHERE kr <= 2 QUALIFY example_no <= 5""")


def _labels():
    out = []
    for gate, kinds in D.HIT_KINDS.items():
        for label, words in kinds:
            tests = [f"contains({'matched_text' if w in ('@', 'for') else 'low'}, {lit(w)})" for w in words]
            out.append(f"CASE WHEN bool_or(gate = '{gate}' AND ({' OR '.join(tests)})) THEN {lit(label)} END")
    return ", ".join(out)


T["kinds"] = f"SELECT project_id, gate, list_filter([{_labels()}], lambda x: x IS NOT NULL) AS kinds FROM low_hits WHERE gate IN ({', '.join(map(lit, D.HIT_KINDS))}) GROUP BY 1, 2"
oracle("g20_gate_kinds", f"SELECT project_id, gate, {joined('kinds')} AS kinds FROM kinds")
T["codes"] = r"SELECT DISTINCT project_id, unnest(regexp_extract_all(matched_text, '\b[2-5]\d{2}\b')) AS code FROM hits WHERE gate = 'http_codes'"
oracle("g21_http_status_codes", "SELECT project_id, string_agg(code, ' | ' ORDER BY code) AS codes FROM codes GROUP BY 1")
oracle("g22_files_per_gate", "SELECT project_id, gate, count(DISTINCT path) AS files FROM hits GROUP BY 1, 2")
oracle("g23_longest_matches", """
SELECT project_id, gate, row_number() OVER (PARTITION BY project_id, gate ORDER BY length(matched_text) DESC, path, line_no, ord) AS rank, length(matched_text) AS match_length, path, line_no, matched_text
FROM hits QUALIFY rank <= 3""")
oracle("g24_request_response_counts", """
SELECT project_id, count(*) FILTER (WHERE contains(low, 'request')) AS request_logs, count(*) FILTER (WHERE contains(low, 'response')) AS response_logs FROM low_hits WHERE gate = 'log_api_calls' GROUP BY 1""")
T["tools"] = """
SELECT DISTINCT project_id, tool FROM (SELECT project_id, CASE WHEN contains(low, 'sentry') THEN 'Sentry' WHEN contains(low, 'rollbar') THEN 'Rollbar' WHEN contains(low, 'bugsnag') THEN 'Bugsnag'
  WHEN contains(low, 'airbrake') THEN 'Airbrake' END AS tool FROM low_hits WHERE gate = 'ui_error_tools') WHERE tool IS NOT NULL"""
oracle("g25_tools_detected", "SELECT project_id, tool FROM tools")
T["advice"] = "SELECT * FROM (VALUES " + rows(advice.advice_rows()) + ") v(gate, bucket, advice_language, position, advice)"
T["bucketed"] = """
SELECT *, CASE WHEN found = 0 THEN 'zero' WHEN gate = 'avoid_logging_secrets' THEN 'quality' WHEN found < expected THEN 'partial' ELSE 'quality' END AS bucket FROM lang_results"""
T["advised"] = f"""
SELECT b.project_id, b.gate, b.language, b.bucket, {big('a.position')} AS position, a.advice FROM bucketed b LEFT JOIN advice a ON a.gate = b.gate AND a.bucket = b.bucket
 AND a.advice_language = CASE WHEN EXISTS (SELECT 1 FROM advice x WHERE x.gate = b.gate AND x.bucket = b.bucket AND x.advice_language = b.language) THEN b.language ELSE '*' END"""
oracle("g26_recommendation_bucket", "SELECT project_id, gate, language, bucket, position, advice FROM advised")

# ---------------------------------------------------------------- technologies

T["tech_rules"] = "SELECT * FROM (VALUES " + rows(TD.technology_rules()) + ") v(language, category, technology, pattern)"
T["tree_known"] = f"SELECT *, {KNOWN} AS language FROM tree"
T["tree_kinds"] = "SELECT DISTINCT project_id, language, content FROM tree_known WHERE language IS NOT NULL"
T["tree_techs"] = "SELECT DISTINCT t.project_id, t.language, r.category, r.technology FROM tree_kinds t JOIN tech_rules r USING (language) WHERE regexp_matches(t.content, '(?im)' || r.pattern)"
T["code_techs"] = "SELECT DISTINCT t.project_id, t.language, r.category, r.technology FROM c1_texts t JOIN tech_rules r USING (language) WHERE regexp_matches(t.content, '(?im)' || r.pattern)"
oracle("t1_detect_technologies", "SELECT * FROM tree_techs UNION SELECT * FROM code_techs")
oracle("t2_technologies_in_manifests", f"""
SELECT DISTINCT m.project_id, l.language, r.category, r.technology FROM tree m JOIN (SELECT DISTINCT project_id, language FROM tree_kinds) l USING (project_id) JOIN tech_rules r USING (language)
WHERE m.path IN ('package.json', 'requirements.txt', 'pom.xml', 'build.gradle', 'Gemfile', 'composer.json', 'project.json') AND regexp_matches(m.content, '(?i)' || r.pattern)
EXCEPT SELECT project_id, language, category, technology FROM tree_techs""")
T["first_texts"] = """
SELECT project_id, lower(content) AS low FROM tree_known WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY path) <= 10
UNION ALL (SELECT project_id, lower(content) FROM c1_texts QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY path) <= 10)"""
oracle("t3_sample_technologies", " UNION ".join(f"SELECT project_id, {lit(c)} AS category, {lit(t)} AS technology FROM first_texts WHERE {has('low', ws)}" for c, t, ws in TD.SAMPLED_TECHNOLOGIES))
T["ui_files"] = "SELECT project_id, path, content FROM tree UNION ALL SELECT project_id, path, content FROM texts"
oracle("t4_has_ui_components", ui_sql("ui_files"))
oracle("t5_has_background_jobs", jobs_sql("ui_files"))
T["tree_ui"] = ui_sql("tree")
T["tree_jobs"] = jobs_sql("tree")
oracle("t6_gate_applicability", """
SELECT project_id, gate, CASE WHEN gate IN ('ui_errors', 'ui_error_tools') THEN has_ui WHEN gate = 'log_background_jobs' THEN has_jobs ELSE true END AS applicable
FROM tree_ui JOIN tree_jobs USING (project_id) CROSS JOIN gate_dim""")
oracle("t7_tech_stack", "SELECT project_id, 'Languages' AS type, concat(upper(language[1]), language[2:]) AS name, 'N/A' AS version, 'detected' AS purpose FROM detected")

# ---------------------------------------------------------------- scoring

oracle("a1_file_analyses", f"""
SELECT project_id, path, language, loc AS lines_of_code FROM file_loc
UNION ALL SELECT project_id, path, 'text', {big(f"len(list_filter(string_split(content, {LF}), lambda x: {strip('x')} <> ''))")} FROM texts""")
oracle("a2_totals", f"SELECT project_id, count(*) AS total_files, {big('sum(loc)')} AS total_lines FROM file_loc GROUP BY 1")
oracle("a3_combine_languages", f"SELECT project_id, gate, expected, found, {r6('quality_score')} AS quality_score FROM combined")
oracle("a3_combine_languages_compat", f"""
SELECT project_id, gate, {big('coalesce(sum(expected) FILTER (WHERE k), 0)')} AS expected, {big('coalesce(sum(found) FILTER (WHERE k), 0)')} AS found, {r6('coalesce(' + mean('quality', LANG_ORD, 'k') + ', 0.0)')} AS quality_score
FROM (SELECT *, NOT (gate IN ('error_logs', 'ui_errors', 'http_codes', 'ui_error_tools') AND found > 0) AS k FROM lang_results) GROUP BY 1, 2""")
oracle("a4_coverage", f"SELECT project_id, gate, {r6('coverage')} AS coverage FROM covered")
oracle("a5_quality_multiplier", f"SELECT project_id, gate, {r6('quality_score')} AS quality_score, {r6('multiplier')} AS multiplier FROM covered")
oracle("a6_gate_score", f"SELECT project_id, gate, {r6('coverage')} AS coverage, {r6('quality_score')} AS quality_score, {r6('final_score')} AS final_score FROM scored")
oracle("a7_score_breakdown", f"""
SELECT project_id, gate, {r6('coverage * 0.7')} AS coverage_contribution, {r6('quality_score * 0.3')} AS quality_contribution, {r6('coverage * 0.7 + quality_score * 0.3')} AS base_score,
  {r6('weight')} AS gate_weight, {r6('multiplier')} AS quality_multiplier, {r6('final_score')} AS final_score FROM scored""")
oracle("a8_gate_status", f"""
SELECT project_id, gate, {big('gate_ord')} AS gate_ord, {big('expected')} AS expected, {big('found')} AS found, {r6('coverage')} AS coverage, {r6('quality_score')} AS quality_score, {r6('final_score')} AS final_score, status FROM final""")
oracle("a9_gate_priority_tier", "SELECT project_id, gate, CASE WHEN weight >= 1.5 THEN 'CRITICAL' WHEN weight >= 1.2 THEN 'HIGH' WHEN weight >= 1.0 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM scored")
oracle("a10_summary_counts", """
SELECT project_id, count(*) FILTER (WHERE status = 'PASS') AS passed_gates, count(*) FILTER (WHERE status = 'WARNING') AS warning_gates, count(*) FILTER (WHERE status IN ('FAIL', 'FAILED')) AS failed_gates,
  count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable_gates FROM final GROUP BY 1""")
oracle("a11_overall_score", f"SELECT project_id, {r6('overall_score')} AS overall_score FROM overall")
oracle("a12_mean_all_gates", f"SELECT project_id, {r6('avg(final_score)')} AS computed_overall_score FROM final GROUP BY 1")
oracle("a13_weighted_overall", f"SELECT project_id, {r6('sum(final_score * weight) / sum(weight)')} AS weighted_overall_score FROM final GROUP BY 1")
oracle("a14_critical_issues", f"SELECT project_id, {joined('critical_issues')} AS critical_issues, {joined('recommendations')} AS recommendations FROM findings")
oracle("a15_threshold_verdict", f"SELECT project_id, {r6('overall_score')} AS overall_score, overall_score >= 70 AS passed FROM overall")
oracle("a16_distributions", """
SELECT project_id, gate, severity, NULL AS pattern_type, count(*) AS hits FROM hits GROUP BY 1, 2, 3 UNION ALL SELECT project_id, gate, NULL, pattern_type, count(*) FROM hits GROUP BY 1, 2, 4""")
oracle("a17_coverage_stats", """
SELECT project_id, gate, count(DISTINCT path) AS total_files, count(*) FILTER (WHERE severity = 'HIGH') AS high_severity_count, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_severity_count,
  count(*) FILTER (WHERE severity = 'LOW') AS low_severity_count, count(*) FILTER (WHERE contains(category, 'security')) AS security_issues, count(*) FILTER (WHERE function_name <> '') AS functions_affected FROM named GROUP BY 1, 2""")
oracle("a18_basic_project_score", f"""
SELECT project_id, total_files, has_tests, has_config, has_readme, {big('t')} AS test_score, {big('c')} AS config_score, {big('d')} AS doc_score, {r6('(t + c + d) / 3.0')} AS overall_score,
  CASE WHEN t >= 70 THEN 'PASS' ELSE 'FAIL' END AS test_status, CASE WHEN c >= 70 THEN 'PASS' ELSE 'FAIL' END AS config_status, CASE WHEN d >= 70 THEN 'PASS' ELSE 'FAIL' END AS doc_status
FROM (SELECT *, CASE WHEN has_tests THEN 80 ELSE 30 END AS t, CASE WHEN has_config THEN 90 ELSE 40 END AS c, CASE WHEN has_readme THEN 85 ELSE 35 END AS d
  FROM (SELECT project_id, count(*) AS total_files, bool_or(contains(lower(ext), 'test')) AS has_tests, bool_or(NOT contains(path, '/') AND file_name IN ('package.json', 'requirements.txt', 'pom.xml', 'build.gradle')) AS has_config,
          bool_or(NOT contains(path, '/') AND lower(file_name) LIKE 'readme%') AS has_readme
        FROM tree WHERE NOT regexp_matches(path, '(^|/)(\\.git|node_modules|__pycache__|target|bin|obj)/') GROUP BY 1))""")
oracle("a19_feasibility", f"""
SELECT o_orderkey, {r6('s')} AS score, CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 80 THEN 'Good' WHEN s >= 70 THEN 'Fair' WHEN s >= 60 THEN 'Marginal' ELSE 'Poor' END AS feasibility
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice) % 101 ELSE 0 END AS s FROM orders)""")

# ---------------------------------------------------------------- windows, sets

oracle("w1_first_files", "SELECT project_id, language, path FROM tree_known WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, language ORDER BY path) <= 20")
T["first_ten"] = "SELECT *, row_number() OVER (PARTITION BY project_id, gate ORDER BY language, path, line_no, ord) AS hit_no FROM hits QUALIFY hit_no <= 10"
oracle("w2_shown_hits", f"""
SELECT project_id, gate, path, hit_no, row_number() OVER (PARTITION BY project_id, gate, path ORDER BY hit_no) AS file_hit_no, line_no,
  CASE WHEN length(trim(matched_text)) > 80 THEN concat(substr(trim(matched_text), 1, 77), '...') ELSE trim(matched_text) END AS shown_text,
  {big('greatest(count(*) OVER (PARTITION BY project_id, gate, path) - 3, 0)')} AS more FROM first_ten QUALIFY file_hit_no <= 3""")
oracle("w3_context", f"""
SELECT f.project_id, f.path, f.line_no, context_start_line, context_end_line, {FUNCTION.replace('line_no - ', 'f.line_no - ')} FROM line_functions f JOIN
 (SELECT project_id, path, line_no, greatest(line_no - 3, 1) AS context_start_line, least(line_no + 3, max(line_no) OVER (PARTITION BY project_id, path)) AS context_end_line FROM c1) USING (project_id, path, line_no)""")
oracle("w4_newest_first", "SELECT file_name, size, modified FROM saved ORDER BY modified DESC, file_name")
oracle("w5_truncations", f"SELECT project_id, gate, {joined('advice[1:5]')} AS first_five, {big('len(advice)')} AS n FROM (SELECT project_id, gate, list(DISTINCT advice ORDER BY advice) FILTER (WHERE advice IS NOT NULL) AS advice FROM advised GROUP BY 1, 2)")
oracle("w6_score_trend", f"""
SELECT CAST(user_id AS VARCHAR) AS project_id, event_id AS scan_id, {r6('value')} AS score, {r6('lag(value) OVER w')} AS previous_score, {r6('value - lag(value) OVER w')} AS change
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
oracle("u1_union_hits", "SELECT project_id, gate, language, count(*) AS hits FROM hits GROUP BY 1, 2, 3")
oracle("u2_distinct_recommendations", """
SELECT project_id, gate, coalesce(string_agg(advice, ' | ' ORDER BY o, position), '') AS recommendations FROM (SELECT project_id, gate, advice, language_ord AS o, position FROM advised JOIN language_dim USING (language) WHERE advice IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY project_id, gate, advice ORDER BY language_ord, position) = 1) GROUP BY 1, 2""")
oracle("u3_distinct_tools", "SELECT 'tool' AS kind, tool AS name FROM tools UNION SELECT 'code', code FROM codes UNION SELECT 'technology', technology FROM tree_techs UNION SELECT 'technology', technology FROM code_techs")

# ---------------------------------------------------------------- reports

oracle("r1_report_gates", f"SELECT project_id, gate, status, {r6('final_score')} AS final_score FROM report_gates")
oracle("r2_report_summary", """
SELECT project_id, count(*) AS total_gates, count(*) FILTER (WHERE kind = 'i') AS implemented_gates, count(*) FILTER (WHERE kind = 'p') AS partial_gates, count(*) FILTER (WHERE kind = 'n') AS not_implemented_gates
FROM (SELECT *, CASE WHEN found > 0 AND gate = 'avoid_logging_secrets' THEN 'n' WHEN found > 0 AND status = 'PASS' THEN 'p' WHEN status = 'PASS' THEN 'i' WHEN status = 'WARNING' THEN 'p' ELSE 'n' END AS kind FROM report_gates) GROUP BY 1""")
oracle("r3_secrets_status", """
SELECT project_id, CASE WHEN found > 0 THEN 'warning' WHEN status = 'PASS' THEN 'safe' ELSE 'unknown' END AS secrets_status,
  CASE WHEN found > 0 THEN concat('Found ', found, ' potential confidential data logging violations') WHEN status = 'PASS' THEN 'No secrets or confidential data detected' ELSE 'Secrets analysis not available' END AS message
FROM report_gates WHERE gate = 'avoid_logging_secrets'""")
oracle("r4_report_rows", """
SELECT r.project_id, r.gate, gate_category, display_name AS practice,
  CASE WHEN found > 0 AND r.gate = 'avoid_logging_secrets' THEN '✗ Violations Found' WHEN found > 0 AND status = 'PASS' THEN '⚬ Has Issues' WHEN status = 'PASS' THEN '✓ Implemented' WHEN status = 'WARNING' THEN '⚬ Partial'
    WHEN status = 'NOT_APPLICABLE' THEN 'N/A' ELSE '✗ Missing' END AS status_text,
  CASE WHEN status = 'NOT_APPLICABLE' THEN 'Not applicable to this project type' WHEN found > 0 THEN concat('Found ', found, ' implementations with ', format('{:.1f}', coverage), '% coverage') ELSE 'No relevant patterns found in codebase' END AS evidence,
  CASE WHEN found > 0 AND r.gate = 'avoid_logging_secrets' THEN concat('Fix confidential data logging violations in ', lower(display_name)) WHEN found > 0 AND status = 'PASS' THEN concat('Address identified issues in ', lower(display_name))
    WHEN status = 'PASS' THEN 'Continue maintaining good practices' WHEN status = 'WARNING' THEN concat('Expand implementation of ', lower(display_name)) WHEN status = 'NOT_APPLICABLE' THEN 'Not applicable to this project type'
    ELSE concat('Implement ', lower(display_name)) END AS recommendation, coalesce(s.comment, '') AS comment
FROM report_gates r JOIN gate_dim d ON d.gate = r.gate LEFT JOIN supplied s ON s.project_id = r.project_id AND s.gate = r.gate""")
T["project_totals"] = f"""
SELECT project_id, count(*) AS total_files, {big('sum(loc)')} AS total_lines FROM file_loc GROUP BY 1"""
oracle("r5_issue_comment", f"""
SELECT project_id, CASE WHEN overall_score >= 80 THEN 'HIGH' WHEN overall_score >= 60 THEN 'MODERATE' ELSE 'LOW' END AS compliance,
  concat('HARD GATE ASSESSMENT REPORT', {LF}, repeat('=', 50), {LF}, {LF}, 'Generated: 2024-01-01 00:00:00', {LF}, {LF}, 'OVERALL SCORE: ', format('{{:.1f}}', overall_score), '%', {LF}, 'FILES ANALYZED: ', total_files, {LF},
    'LINES OF CODE: ', format('{{:,}}', total_lines), {LF}, {LF}, 'GATE SUMMARY:', {LF}, '- Implemented: ', ok, {LF}, '- Failed: ', bad, {LF}, '- Total Applicable: ', n, {LF}, {LF},
    CASE WHEN len(recommendations) > 0 THEN concat('RECOMMENDATIONS:', {LF}, array_to_string(list_transform(recommendations[1:3], lambda r, i: concat(i, '. ', r)), {LF}), {LF}, {LF}) ELSE '' END) AS comment
FROM overall JOIN project_totals USING (project_id) JOIN findings USING (project_id)
JOIN (SELECT project_id, count(*) FILTER (WHERE status = 'PASS') AS ok, count(*) FILTER (WHERE status IN ('FAIL', 'FAILED')) AS bad, count(*) FILTER (WHERE applicable) AS n FROM final GROUP BY 1) USING (project_id)""")
SIGN = "CASE status WHEN 'PASS' THEN '✅' WHEN 'WARNING' THEN '⚠️' WHEN 'FAIL' THEN '❌' WHEN 'FAILED' THEN '❌' WHEN 'NOT_APPLICABLE' THEN '🚫' ELSE '❓' END"
_bars = "concat('| ', " + "list_aggregate(list_transform(string_split(gate, '_'), lambda w: concat(upper(w[1]), w[2:])), 'string_agg', ' ')" + f", ' | ', {SIGN}, ' ', status, ' | ', format('{{:.1f}}', final_score), '% | ', format('{{:.1f}}', coverage), '% |')"
T["category_dim"] = "SELECT * FROM (VALUES " + rows((c, i) for i, c in enumerate(D.CATEGORIES)) + ") v(gate_category, category_ord)"
T["category_tables"] = f"""
SELECT project_id, category_ord, concat('#### ', gate_category, {LF}, {LF}, '| Gate | Status | Score | Coverage |', {LF}, '|------|--------|-------|----------|', {LF}, string_agg({_bars}, {LF} ORDER BY f.gate_ord)) AS t
FROM final f JOIN (SELECT gate, gate_category FROM gate_dim) USING (gate) JOIN category_dim USING (gate_category) GROUP BY project_id, category_ord, gate_category"""
oracle("r5_issue_comment_markdown", f"""
SELECT project_id, CASE WHEN overall_score >= 80 THEN 'HIGH' WHEN overall_score >= 60 THEN 'MODERATE' ELSE 'LOW' END AS compliance,
  concat('## 🛡️ Hard Gate Assessment Report', {LF}, {LF}, '**Generated:** 2024-01-01 00:00:00', {LF}, {LF}, '---', {LF}, {LF}, '### 📊 Executive Summary', {LF}, {LF}, '| Metric | Value |', {LF}, '|--------|-------|', {LF},
    '| **Overall Score** | **', format('{{:.1f}}', overall_score), '%** |', {LF}, '| Total Gates | ', n, ' |', {LF}, '| ✅ Implemented | ', ok, ' |', {LF}, '| ⚠️ Partial | ', mid, ' |', {LF}, '| ❌ Failed | ', bad, ' |', {LF},
    '| 🚫 Not Applicable | ', na, ' |', {LF}, '| Files Analyzed | ', total_files, ' |', {LF}, '| Lines of Code | ', format('{{:,}}', total_lines), ' |', {LF}, {LF},
    CASE WHEN overall_score >= 80 THEN '🟢 **HIGH COMPLIANCE** - Excellent gate coverage' WHEN overall_score >= 60 THEN '🟡 **MODERATE COMPLIANCE** - Some improvements needed' ELSE '🔴 **LOW COMPLIANCE** - Significant improvements required' END,
    {LF}, {LF}, '### 🔍 Gate Details', {LF}, {LF}, details, {LF}, {LF},
    CASE WHEN len(recommendations) > 0 THEN concat('### 💡 Recommendations', {LF}, {LF}, array_to_string(list_transform(recommendations[1:5], lambda r, i: concat(i, '. ', r)), {LF}), {LF}, {LF}) ELSE '' END,
    CASE WHEN len(critical_issues) > 0 THEN concat('### ⚠️ Critical Issues', {LF}, {LF}, array_to_string(list_transform(critical_issues, lambda r: concat('- 🚨 ', r)), {LF}), {LF}, {LF}) ELSE '' END, '---', {LF}) AS comment
FROM overall JOIN project_totals USING (project_id) JOIN findings USING (project_id)
JOIN (SELECT project_id, string_agg(t, {LF} || {LF} ORDER BY category_ord) AS details FROM category_tables GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS ok, count(*) FILTER (WHERE status = 'WARNING') AS mid, count(*) FILTER (WHERE status IN ('FAIL', 'FAILED')) AS bad,
        count(*) FILTER (WHERE NOT applicable) AS na FROM final GROUP BY 1) USING (project_id)""")
oracle("r6_report_listing", """
SELECT scan_id, file_name, size, modified, CASE WHEN size < 1024 THEN concat(size, ' B') WHEN size < 1048576 THEN concat(format('{:.1f}', size / 1024), ' KB') ELSE concat(format('{:.1f}', size / 1048576), ' MB') END AS size_text,
  coalesce(status, 'unknown') AS status, round(score, 6) AS score FROM saved LEFT JOIN runs USING (scan_id)""")
oracle("r7_expired_reports", "SELECT file_name, modified FROM saved WHERE modified < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 2 DAYS")
oracle("r8_comments_hash", """
SELECT project_id, substr(md5(concat('{', string_agg(concat('"', gate, '": "', comment, '"'), ', ' ORDER BY gate), '}')), 1, 8) AS comments_hash FROM supplied GROUP BY 1""")
T["graded_issues"] = """
SELECT h.project_id, h.gate, h.path, h.line_no, h.column_start, h.matched_text AS message, CASE WHEN final_score >= 80 THEN 'PASSED' WHEN final_score >= 60 THEN 'WARNING' ELSE 'FAILED' END AS gate_status,
  CASE WHEN final_score >= 80 THEN 'info' WHEN final_score >= 60 THEN 'warning' ELSE 'error' END AS severity
FROM hits h JOIN final USING (project_id, gate)"""
oracle("r9_issues", "SELECT project_id, severity, count(*) AS issues FROM graded_issues GROUP BY 1, 2")


def title(e):
    return f"list_aggregate(list_transform(string_split({e}, '_'), lambda w: concat(upper(w[1]), w[2:])), 'string_agg', ' ')"


T["view_weights"] = "SELECT * FROM (VALUES " + rows(D.VIEW_WEIGHTS.items()) + ") v(gate, vw)"
oracle("r10_gates_by_tier", f"""
SELECT project_id, gate, {title('gate')} AS label, {r6('coalesce(vw, 1.0)')} AS view_weight, CASE WHEN coalesce(vw, 1.0) >= 1.8 THEN 'Critical Gates' WHEN coalesce(vw, 1.0) >= 1.4 THEN 'High Priority Gates' ELSE 'Medium Priority Gates' END AS tier
FROM final LEFT JOIN view_weights USING (gate)""")
oracle("r11_compliance", f"""
SELECT project_id, count(*) AS total_gates, count(*) FILTER (WHERE final_score >= 80) AS passed, count(*) FILTER (WHERE final_score >= 60 AND final_score < 80) AS warning, count(*) FILTER (WHERE final_score < 60) AS failed,
  {big('floor(max(overall_score) + 0.5)')} AS score, {r6('count(*) FILTER (WHERE final_score >= 80) / count(*) * 100')} AS compliance_percentage,
  CASE WHEN floor(max(overall_score) + 0.5) >= 80 THEN 'Production Ready' WHEN floor(max(overall_score) + 0.5) >= 60 THEN 'Needs Improvement' ELSE 'Not Production Ready' END AS readiness
FROM final JOIN overall USING (project_id) GROUP BY 1""")
oracle("r12_recommendation_rows", f"""
SELECT project_id, gate, language, position, advice, concat({title('gate')}, ': ', CASE WHEN length(advice) > 50 THEN concat(substr(advice, 1, 50), '...') ELSE advice END) AS label,
  CASE WHEN length(advice) > 60 THEN concat(substr(advice, 1, 60), '...') ELSE advice END AS general_label FROM advised WHERE advice IS NOT NULL""")
oracle("r13_diagnostics", f"""
SELECT project_id, gate, path, {big('greatest(line_no - 1, 0)')} AS line, {big('column_start')} AS start_column, {big('column_start + 10')} AS end_column, concat(gate, ': ', message) AS text, severity FROM graded_issues WHERE gate_status = 'FAILED'""")
oracle("r14_format_gate_name", f"""
SELECT gate, coalesce(display_name, {title('gate')}) AS display_name, {title('gate')} AS view_name FROM (SELECT gate FROM gate_dim UNION ALL SELECT DISTINCT concat(event_type, '_rate_limit') FROM events) LEFT JOIN gate_dim USING (gate)""")
oracle("r15_component_declarations", """
SELECT s_name AS component_name, CASE WHEN s_acctbal > 5000 THEN 'High' ELSE 'Medium' END AS business_criticality, CASE WHEN s_nationkey > 12 THEN 'cloud' ELSE 'Unknown' END AS current_environment, 'Unknown' AS application_type,
  d AS declaration, CASE d WHEN 'database' THEN s_acctbal > 0 ELSE s_nationkey > 5 END AS is_yes FROM supplier, unnest(['database', 'cache']) u(d)""")
# ---------------------------------------------------------------- details of gates


def filled(text, *values):
    """A text with %d and %s in it as a concatenation."""
    parts = re.split("%[ds]", text)
    args = [lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        args += [value, lit(part)]
    return f"concat({', '.join(args)})"


def some(items):
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def titled(title, shown):
    """The title with what there is to show; null without anything."""
    return f"CASE WHEN len({shown}) > 0 THEN concat({lit(title)}, array_to_string({shown}, ', ')) END"


def _own_texts(gate):
    spec, items = DT.DETAILS[gate], []
    if "head" in spec:
        items.append(filled(spec["head"], "count(*)"))
    if "files" in spec:
        items.append(filled(spec["files"], "count(DISTINCT path)"))
    at = 0
    for size, title in spec.get("kinds", []):
        shown = []
        for label, words in D.HIT_KINDS[gate][at : at + size]:
            tests = [f"contains({'matched_text' if w in D.RAW_WORDS else 'low'}, {lit(w)})" for w in words]
            shown.append(f"CASE WHEN bool_or({' OR '.join(tests)}) THEN {lit(label)} END")
        items.append(titled(f"{title}: ", some(shown)))
        at += size
    if gate == "log_api_calls":
        for word, text in (("request", DT.REQUESTS), ("response", DT.RESPONSES)):
            n = f"count(*) FILTER (WHERE contains(low, '{word}'))"
            items.append(f"CASE WHEN {n} > 0 THEN {filled(text, n)} END")
    if gate == "http_codes":
        items.append(titled(DT.CODES_USED, r"list_sort(list_distinct(flatten(list(regexp_extract_all(matched_text, '\b[2-5]\d{2}\b')))))"))
    if gate == "ui_error_tools":
        first = "CASE " + " ".join(f"WHEN contains(low, '{t.lower()}') THEN '{t}'" for t in D.ERROR_TOOLS) + " END"
        items.append(titled(DT.TOOLS_FOUND, some(f"CASE WHEN bool_or({first} = '{t}') THEN '{t}' END" for t in D.ERROR_TOOLS)))
    return some(items)


T["d_own"] = " UNION ALL ".join(
    f"SELECT project_id, '{g}' AS gate, language, count(*) AS n, {_own_texts(g)} AS texts FROM low_hits WHERE gate = '{g}' GROUP BY project_id, language" for g in D.GATES
)
T["d_longest"] = f"""
SELECT project_id, language, list({filled(DT.DETAILS['structured_logs']['longest'], 'path', 'length(matched_text)')} ORDER BY r) AS texts FROM
 (SELECT *, row_number() OVER (PARTITION BY project_id, language ORDER BY length(matched_text) DESC, path, line_no, ord) AS r FROM hits WHERE gate = 'structured_logs' QUALIFY r <= 3) GROUP BY 1, 2"""
_band = "CASE " + " ".join(f"WHEN c >= {n} THEN {lit(t)}" for n, t in DT.VIOLATION_BANDS) + f" ELSE {lit(DT.VIOLATION_BAND_ELSE)} END"
_kind_ord = "CASE violation_kind " + " ".join(f"WHEN {lit(k)} THEN {i}" for i, (k, _) in enumerate(D.VIOLATION_KINDS)) + " ELSE 99 END"
_example_ord = "CASE violation_kind " + " ".join(f"WHEN {lit(k)} THEN {i}" for i, k in enumerate(D.EXAMPLE_KINDS)) + " END"
T["d_violations"] = f"""
SELECT project_id, language, list(concat('  ', {_band}, ' ', violation_kind, ': ', c, ' violations') ORDER BY c DESC, {_kind_ord}) AS texts
FROM (SELECT project_id, language, violation_kind, count(*) AS c FROM leaks GROUP BY 1, 2, 3) GROUP BY 1, 2"""
T["d_examples"] = f"""
SELECT project_id, language, list(concat('   ', list_last(string_split(path, '/')), ':', line_no, ' - ', substr(matched_text, 1, 60), '...') ORDER BY r) AS texts FROM
 (SELECT *, row_number() OVER (PARTITION BY project_id, language ORDER BY {_example_ord}, kr) AS r FROM
   (SELECT *, row_number() OVER (PARTITION BY project_id, language, violation_kind ORDER BY path, line_no, ord) AS kr FROM leaks WHERE violation_kind IN ({', '.join(map(lit, D.EXAMPLE_KINDS))})) WHERE kr <= 2 QUALIFY r <= 5) GROUP BY 1, 2"""
_ordered = {}
for _l, _c, _t, _ in TD.technology_rules():
    _ordered.setdefault((_l, _c, _t), len(_ordered))
T["d_tech_order"] = "SELECT * FROM (VALUES " + rows((*k, i, k[1].title()) for k, i in _ordered.items()) + ") v(language, category, technology, o, title)"
T["d_techs"] = """
SELECT project_id, language, category, any_value(title) AS title, min(o) AS o, list(technology ORDER BY o) AS names FROM code_techs JOIN d_tech_order USING (language, category, technology) GROUP BY 1, 2, 3"""
T["d_tech_texts"] = """
SELECT project_id, language, list(concat('  ', category, ': ', len(names), ' files') ORDER BY o) AS counted, list(concat('  ', title, ': ', array_to_string(names, ', ')) ORDER BY o) AS named FROM d_techs GROUP BY 1, 2"""
_none = "CASE e.gate " + " ".join(f"WHEN '{g}' THEN {lit(DT.DETAILS[g]['none'])}" for g in D.GATES) + " END"
_tech = " ".join(f"WHEN '{g}' THEN CASE WHEN t.named IS NULL THEN [] ELSE list_concat([{lit(s['tech'])}], t.named) END" for g, s in DT.DETAILS.items() if "tech" in s and "longest" not in s)
_structured = f"list_concat(l.texts, list_concat([{lit(DT.DETAILS['structured_logs']['tech'])}], coalesce(t.counted, [])))"
_secret = f"""list_concat(list_concat([{lit(DT.BY_CATEGORY)}], v.texts), list_concat(list_concat([{lit(DT.EXAMPLES)}], coalesce(x.texts, [])),
    CASE WHEN o.n > 5 THEN [{filled(DT.MORE_VIOLATIONS, 'o.n - 5')}, {lit(DT.WARNING)}] ELSE [{lit(DT.WARNING)}] END))"""
T["d_language"] = f"""
SELECT e.project_id, e.gate, e.language, CASE WHEN o.n IS NULL THEN [{_none}] ELSE list_concat(o.texts, CASE e.gate WHEN 'structured_logs' THEN {_structured}
    WHEN 'avoid_logging_secrets' THEN {_secret} {_tech} ELSE [] END) END AS texts
FROM lang_results e LEFT JOIN d_own o USING (project_id, gate, language) LEFT JOIN d_longest l ON l.project_id = e.project_id AND l.language = e.language
LEFT JOIN d_violations v ON v.project_id = e.project_id AND v.language = e.language LEFT JOIN d_examples x ON x.project_id = e.project_id AND x.language = e.language
LEFT JOIN d_tech_texts t ON t.project_id = e.project_id AND t.language = e.language"""
_short = "CASE WHEN length(trim(matched_text)) > 80 THEN concat(substr(trim(matched_text), 1, 77), '...') ELSE trim(matched_text) END"
T["d_shown"] = f"""
SELECT project_id, gate, path, min(hit_no) AS first, list_concat(list_concat([{filled(DT.MATCHES_OF_FILE, 'path')}],
    flatten(list([{filled(DT.MATCH, 'line_no', _short)}, {filled(DT.PATTERN, 'pattern')}] ORDER BY hit_no)[1:3])), CASE WHEN count(*) > 3 THEN [{filled(DT.MORE_MATCHES, 'count(*) - 3')}] ELSE [] END) AS texts
FROM first_ten GROUP BY project_id, gate, path"""
T["d_first"] = f"""
SELECT project_id, gate, list_concat([{filled(DT.MATCHES, 'any_value(n)')}], flatten(list(texts ORDER BY first))) AS texts
FROM d_shown JOIN (SELECT project_id, gate, count(*) AS n FROM hits GROUP BY 1, 2) USING (project_id, gate) GROUP BY 1, 2"""
T["d_advice"] = """
SELECT project_id, gate, list(advice ORDER BY o, position) AS advice FROM (SELECT project_id, gate, advice, language_ord AS o, position FROM advised JOIN language_dim USING (language) WHERE advice IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY project_id, gate, advice ORDER BY language_ord, position) = 1) GROUP BY 1, 2"""
T["gate_details"] = f"""
SELECT f.project_id, f.gate, CASE WHEN applicable THEN list_concat(d.texts, coalesce(s.texts, [])) ELSE [{filled(DT.NOT_APPLICABLE, 'f.gate')}] END AS details,
  CASE WHEN applicable THEN coalesce(a.advice, []) ELSE [{filled(DT.NO_ACTION, 'f.gate')}] END AS recommendations
FROM final f JOIN (SELECT project_id, gate, flatten(list(texts ORDER BY language_ord)) AS texts FROM d_language JOIN language_dim USING (language) GROUP BY 1, 2) d USING (project_id, gate)
LEFT JOIN d_first s USING (project_id, gate) LEFT JOIN d_advice a USING (project_id, gate)"""
oracle("a3_gate_details", f"SELECT project_id, gate, {joined('details')} AS details, {joined('recommendations')} AS recommendations FROM gate_details")

oracle("s4_json_reports", f"""
SELECT o.project_id AS project_name, language, '2024-01-01T00:00:00' AS scan_date, {r6('overall_score')} AS overall_score, total_files, total_lines, total_gates, partial_gates,
  total_gates AS gate_count, 'structured_logs' AS first_name, {r6('first_score')} AS first_score, array_to_string(details, ' | ') AS first_details, {joined('critical_issues')} AS critical_issues, {joined('recommendations')} AS recommendations
FROM overall o JOIN findings USING (project_id)
JOIN (SELECT project_id, count(*) AS total_gates, count(*) FILTER (WHERE (found > 0 AND gate <> 'avoid_logging_secrets' AND status = 'PASS') OR (status = 'WARNING' AND NOT (found > 0 AND gate = 'avoid_logging_secrets'))) AS partial_gates,
        max(final_score) FILTER (WHERE gate = 'structured_logs') AS first_score FROM report_gates GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, details FROM gate_details WHERE gate = 'structured_logs') USING (project_id)
JOIN (SELECT project_id, count(*) AS total_files, {big('sum(loc)')} AS total_lines,
        arg_min(language, {LANG_ORD}) AS language FROM file_loc GROUP BY 1) USING (project_id)""")
oracle("r16_api_gates", f"""
SELECT project_id, gate, CASE WHEN status = 'NOT_APPLICABLE' THEN status WHEN final_score >= 80 THEN 'PASS' WHEN final_score >= 60 THEN 'WARNING' ELSE 'FAIL' END AS status,
  {joined("details[1:5]")} AS details
FROM final JOIN gate_details USING (project_id, gate)""")

# ---------------------------------------------------------------- scoring model

T["samples"] = f"""
SELECT project_id, gate, hit_no AS sample_no, {strip("coalesce(nullif(matched_text, ''), nullif(full_line, ''), pattern)")} AS sample FROM first_ten"""
oracle("x1_code_samples", "SELECT project_id, gate, sample_no, sample FROM samples WHERE sample <> ''")
_rel = "CASE gate " + " ".join(
    f"WHEN '{g}' THEN " + " + ".join(f"contains(lower(sample), {lit(w)})::INT" for w in ws) for g, ws in D.SAMPLE_WORDS.items()
) + " END"
oracle("x2_relevant_samples", f"""
SELECT project_id, gate, sample_no, sample, {big('rk')} AS relevance, row_number() OVER (PARTITION BY project_id, gate ORDER BY rk DESC, sample_no) AS position
FROM (SELECT *, CASE WHEN anyk THEN coalesce(rel, 0) ELSE 0 END AS rk FROM
  (SELECT *, bool_or(k) OVER (PARTITION BY project_id, gate) AS anyk FROM
    (SELECT *, rel IS NULL OR rel > 0 OR len(list_filter(regexp_split_to_array(sample, '\\s+'), lambda w: w <> '')) < 10 AS k FROM (SELECT *, {_rel} AS rel FROM samples))) WHERE k OR NOT anyk)
QUALIFY position <= 5""")
oracle("x3_budget_samples", f"""
SELECT project_id, gate, position, sample, running_chars FROM (SELECT *, {big('sum(length(sample)) OVER (PARTITION BY project_id ORDER BY position)')} AS running_chars FROM
  (SELECT source AS project_id, 'error_logs' AS gate, doc_id AS position, CASE WHEN length(text) > 2000 THEN concat(substr(text, 1, 2000), '... [truncated]') ELSE text END AS sample FROM documents)) WHERE running_chars <= 15000""")
T["answers"] = ANSWER_SQL
T["gate_totals"] = f"""
SELECT project_id, gate, {big('sum(expected)')} AS e, {big('sum(found)')} AS n FROM lang_results GROUP BY 1, 2"""
T["grade_lines"] = f"""
SELECT project_id, gate, string_agg(concat('- ', severity, ': ', c, ' issues'), {LF} ORDER BY severity) AS grades FROM (SELECT project_id, gate, severity, count(*) AS c FROM named GROUP BY 1, 2, 3) GROUP BY 1, 2"""
T["shown_samples"] = f"""
SELECT project_id, gate, string_agg(concat(no, '. File: ', path, ', Line: ', line_no, {LF}, '   Code: ', matched_text, {LF}, '   Severity: ', severity, ', Function: ', function_name), {LF} ORDER BY no) AS texts
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, gate ORDER BY language, path, line_no, ord) AS no FROM named QUALIFY no <= 5) GROUP BY 1, 2"""
T["shares"] = "SELECT *, CASE WHEN e > 0 THEN CAST(n AS DOUBLE) / e * 100 ELSE 0.0 END AS share FROM gate_totals"
oracle("x4_gate_prompts", f"""
SELECT project_id, gate, concat('Gate: ', gate, {LF}, 'Coverage: ', n, '/', e, ' patterns found (', p, '% coverage)', {LF}, 'Status: ',
    CASE WHEN CAST(p AS DOUBLE) >= 80 THEN 'PASS' WHEN CAST(p AS DOUBLE) < 60 THEN 'FAIL' ELSE 'WARNING' END,
    {LF}, {LF}, 'Severity Distribution:', {LF}, coalesce(grades, ''), {LF}, {LF}, 'Sample Code Patterns Found:', {LF}, coalesce(texts, ''), {LF}, {LF},
    'Give 3 to 5 specific, actionable recommendations as a JSON object {{"quality_score": <0-100>, "recommendations": [...]}}.') AS prompt
FROM (SELECT *, format('{{:.1f}}', share) AS p FROM shares) LEFT JOIN grade_lines USING (project_id, gate) LEFT JOIN shown_samples USING (project_id, gate)""")
oracle("x5_parse_model_response", f"""
SELECT a.event_id, {r6("CASE e.event_type WHEN 'view' THEN floor(e.value * 100) WHEN 'click' THEN floor(e.value) + 0.5 ELSE 50.0 END")} AS quality_score,
  CASE e.event_type WHEN 'view' THEN 'use view | log more' WHEN 'click' THEN 'first of click | second' ELSE '' END AS recommendations FROM answers a JOIN events e USING (event_id)""")
T["advice_texts"] = """
SELECT concat('e', event_id) AS id, text FROM answers UNION ALL SELECT concat('c', conv_id, '.', turn), text FROM conversations WHERE role = 'assistant'"""
_clean = rf"list_transform(string_split(text, {LF}), lambda x: regexp_replace(regexp_replace({strip('x')}, '^[-*•]\s*', ''), '^\d+\.\s*', ''))"
oracle("x6_parse_recommendations", f"""
SELECT id, {joined("list_filter(ls, lambda x: length(x) > 20)[1:5]")} AS recommendations, {joined("list_filter(ls, lambda x: length(x) > 10)[1:5]")} AS base_recommendations FROM (SELECT id, {_clean} AS ls FROM advice_texts)""")
oracle("x7_fallback_quality", f"""
SELECT project_id, gate, hits, high, {r6('CASE WHEN high > 5 THEN 30.0 WHEN high > 0 THEN 50.0 ELSE 70.0 END')} AS quality_score FROM (SELECT project_id, gate, count(*) AS hits, count(*) FILTER (WHERE severity = 'HIGH') AS high FROM hits GROUP BY 1, 2)""")
oracle("x7_simple_fallback", """
SELECT project_id, gate, CAST(60 AS DOUBLE) AS quality_score, count(*) FILTER (WHERE contains(lower(sample), 'logger')) AS logging, count(*) FILTER (WHERE contains(lower(sample), 'try') AND contains(lower(sample), 'catch')) AS handling,
  count(*) FILTER (WHERE contains(lower(sample), 'async') OR contains(lower(sample), 'await')) AS async FROM samples WHERE sample <> '' GROUP BY 1, 2""")
oracle("x8_gate_batch_order", f"""
SELECT project_id, gate, {big("CASE WHEN gate IN ('structured_logs', 'avoid_logging_secrets', 'error_logs', 'audit_trail') THEN 3 WHEN gate IN ('correlation_id', 'retry_logic', 'timeouts', 'circuit_breakers', 'automated_tests') THEN 2 ELSE 1 END")} AS batch_priority FROM combined""")
T["answer_values"] = """
SELECT event_id, CASE event_type WHEN 'view' THEN floor(value * 100) WHEN 'click' THEN floor(value) + 0.5 ELSE 50.0 END AS q,
  CASE event_type WHEN 'view' THEN 'use view | log more' WHEN 'click' THEN 'first of click | second' ELSE '' END AS r FROM events"""
oracle("x9_apply_enhancement", f"""
SELECT f.project_id, f.gate, {r6('CASE WHEN e.q IS NULL THEN f.quality_score ELSE greatest(0.0, least(e.q, 100.0)) END')} AS quality_score, {r6('f.final_score')} AS final_score,
  CASE WHEN coalesce(e.r, '') <> '' THEN e.r ELSE {joined('g.recommendations')} END AS recommendations, coalesce(e.s, '') AS insights
FROM final f JOIN gate_details g USING (project_id, gate) LEFT JOIN (SELECT concat('proj', event_id % 8) AS project_id, gate, max(q) AS q, arg_max(r, event_id) AS r, concat('answers: ', count(*)) AS s FROM answer_values JOIN gate_dim ON gate_ord = event_id % 15 GROUP BY 1, 2) e
  ON e.project_id = f.project_id AND e.gate = f.gate""")
oracle("x10_score_with", f"SELECT project_id, gate, {r6('avg(length(sample) % 101)')} AS quality_score FROM samples WHERE sample <> '' GROUP BY 1, 2")

# ---------------------------------------------------------------- streams

oracle("st1_stream_matches", f"""
SELECT {KEY}, {big('column_start')} AS column_start, severity, category, {big("CASE severity WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 ELSE 2 END")} AS priority FROM hits""")
oracle("st2_scan_status_latest", "SELECT user_id AS scan_id, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS ts FROM events GROUP BY 1")
oracle("udtf_scan_text", f"SELECT {KEY}, gate, matched_text, {big('column_start')} AS column_start, {big('column_end')} AS column_end FROM hits")
