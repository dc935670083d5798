"""The fifteen gates, their weights, expected counts and quality bonuses."""

GATES = (
    "structured_logs avoid_logging_secrets audit_trail correlation_id log_api_calls log_background_jobs "
    "ui_errors retry_logic timeouts throttling circuit_breakers error_logs http_codes ui_error_tools "
    "automated_tests"
).split()
GATE_ORD = {g: i for i, g in enumerate(GATES)}
SECRETS_GATE = "avoid_logging_secrets"

WEIGHTS = {
    "avoid_logging_secrets": 2.0,
    "error_logs": 1.8,
    "structured_logs": 1.6,
    "audit_trail": 1.5,
    "automated_tests": 1.4,
    "retry_logic": 1.3,
    "circuit_breakers": 1.3,
    "timeouts": 1.2,
    "http_codes": 1.2,
    "correlation_id": 1.1,
    "log_api_calls": 1.1,
    "throttling": 1.0,
    "ui_errors": 1.0,
    "ui_error_tools": 1.0,
    "log_background_jobs": 0.9,
}

# Weights of the editor view; gates not listed weigh 1.0.
VIEW_WEIGHTS = {
    "structured_logs": 2.0,
    "avoid_logging_secrets": 2.0,
    "audit_trail": 1.8,
    "error_logs": 1.8,
    "circuit_breakers": 1.7,
    "timeouts": 1.6,
    "ui_errors": 1.5,
    "correlation_id": 1.5,
    "automated_tests": 1.5,
    "ui_error_tools": 1.4,
    "retry_logic": 1.4,
    "throttling": 1.3,
    "http_codes": 1.2,
}

CATEGORIES = {
    "Auditability": (
        "structured_logs avoid_logging_secrets audit_trail correlation_id log_api_calls "
        "log_background_jobs ui_errors"
    ).split(),
    "Availability": "retry_logic timeouts throttling circuit_breakers".split(),
    "Error Handling": "error_logs http_codes ui_error_tools".split(),
    "Testing": ["automated_tests"],
}
CATEGORY_OF = {g: c for c, gs in CATEGORIES.items() for g in gs}

DISPLAY_NAMES = {
    "structured_logs": "Logs Searchable Available",
    "avoid_logging_secrets": "Avoid Logging Confidential Data",
    "audit_trail": "Create Audit Trail Logs",
    "correlation_id": "Tracking ID For Log Messages",
    "log_api_calls": "Log Rest API Calls",
    "log_background_jobs": "Log Application Messages",
    "ui_errors": "Client UI Errors Logged",
    "retry_logic": "Retry Logic",
    "timeouts": "Set Timeouts IO Operations",
    "throttling": "Throttling Drop Request",
    "circuit_breakers": "Circuit Breakers Outgoing Requests",
    "error_logs": "Log System Errors",
    "http_codes": "Use HTTP Standard Error Codes",
    "ui_error_tools": "Include Client Error Tracking",
    "automated_tests": "Automated Regression Testing",
}

# Gate name used in exported rule ids.
EXPORT_NAMES = {
    "structured_logs": "StructuredLogs",
    "avoid_logging_secrets": "SecretLogs",
    "audit_trail": "AuditTrail",
    "correlation_id": "CorrelationId",
    "log_api_calls": "ApiLogs",
    "log_background_jobs": "BackgroundJobLogs",
    "ui_errors": "UiErrors",
    "retry_logic": "RetryLogic",
    "timeouts": "Timeouts",
    "throttling": "Throttling",
    "circuit_breakers": "CircuitBreaker",
    "error_logs": "ErrorLogs",
    "http_codes": "HttpCodes",
    "ui_error_tools": "UiErrorTools",
    "automated_tests": "AutomatedTests",
}

# Expected hits of a gate for one project and language with at least one file:
#   greatest(times * floor(named / per), floor(files / files_per), least) + floor(loc / loc_per) + add * named
# ``named`` counts files whose lower-cased path contains one of ``words`` (or none of them, if ``without``).
# ``fallback``: (words, per) used for ``named`` when it is 0: greatest(floor(count / per), 1).
EXPECTED = {
    "structured_logs": {"words": "service controller handler manager", "times": 0, "files_per": 2, "least": 1,
                        "loc_per": 100, "add": 3},
    "avoid_logging_secrets": {"words": "", "times": 0, "least": 0},
    "audit_trail": {"words": "service controller handler manager repository dao model entity", "times": 2,
                    "least": 5},
    "correlation_id": {"words": "controller handler router middleware api web http", "times": 1, "least": 3},
    "log_api_calls": {"words": "controller handler router api endpoint resource", "times": 2, "least": 5},
    "log_background_jobs": {"words": "job task worker scheduler cron background queue", "times": 2, "least": 3,
                            "fallback": ("service manager", 3)},
    "ui_errors": {"words": "view template component page ui frontend web controller", "times": 1, "per": 2,
                  "least": 1},
    "retry_logic": {"words": "client service api http rest repository dao connector", "times": 2,
                    "files_per": 3, "least": 0},
    "timeouts": {"words": "client service api http rest repository dao connector network", "times": 2,
                 "files_per": 4, "least": 0},
    "throttling": {"words": "controller handler router api endpoint resource middleware", "times": 1, "per": 3,
                   "least": 1},
    "circuit_breakers": {"words": "client service api connector integration external remote", "times": 1,
                         "per": 2, "least": 1},
    "error_logs": {"words": "service controller handler manager repository dao api web", "times": 2,
                   "files_per": 3, "least": 0},
    "http_codes": {"words": "controller handler router api endpoint resource web", "times": 3, "least": 5},
    "ui_error_tools": {"words": "", "times": 0, "least": 1},
    "automated_tests": {"words": "test spec __tests__ tests", "without": True, "times": 2, "files_per": 2,
                        "least": 0},
}

# Quality bonuses: least(hits whose lower-cased matched text contains a word * each, cap).
# ``regex`` uses patterns instead of words; ``files`` counts distinct files from 3 on; ``flat`` adds cap once.
BONUSES = {
    "structured_logs": [
        {"words": ["json"], "each": 5, "cap": 15},
        {"words": ["correlation", "request_id", "user_id", "trace_id", "session"], "each": 3, "cap": 10},
        {"files": 3, "each": 2, "cap": 10},
        {"words": ["error", "warn", "info", "debug"], "each": 2, "cap": 10},
    ],
    "avoid_logging_secrets": [],
    "audit_trail": [
        {"words": ["create", "update", "delete", "login", "logout", "access"], "each": 5, "cap": 20},
        {"words": ["user", "admin", "actor"], "each": 3, "cap": 15},
    ],
    "correlation_id": [
        {"words": ["uuid", "guid", "random"], "each": 5, "cap": 15},
        {"words": ["x-correlation-id", "x-request-id", "header"], "each": 5, "cap": 15},
    ],
    "log_api_calls": [
        {"words": ["request"], "each": 3, "cap": 10},
        {"words": ["response"], "each": 3, "cap": 10},
        {"words": ["endpoint", "route", "path"], "each": 2, "cap": 10},
    ],
    "log_background_jobs": [
        {"words": ["start", "complete", "failed", "retry"], "each": 3, "cap": 15},
        {"words": ["error", "exception", "failed"], "each": 2, "cap": 10},
    ],
    "ui_errors": [
        {"words": ["errorboundary", "componentdidcatch", "error.*boundary"], "each": 5, "cap": 15},
        {"words": ["user.*friendly", "message", "alert", "notification"], "each": 3, "cap": 10},
    ],
    "retry_logic": [
        {"words": ["@retry", "@retryable", "retry_template"], "each": 5, "cap": 15},
        {"words": ["backoff", "exponential", "linear", "delay"], "each": 3, "cap": 10},
    ],
    "timeouts": [
        {"words": ["connect", "connection"], "each": 3, "cap": 10},
        {"words": ["read", "response", "socket"], "each": 3, "cap": 10},
    ],
    "throttling": [
        {"words": ["@", "decorator", "middleware"], "each": 5, "cap": 15},
        {"words": ["bucket4j", "resilience4j", "slowapi", "express-rate-limit"], "each": 3, "cap": 10},
    ],
    "circuit_breakers": [
        {"words": ["resilience4j", "hystrix", "polly", "opossum", "pybreaker"], "each": 5, "cap": 15},
        {"words": ["threshold", "timeout", "recovery", "fallback"], "each": 2, "cap": 10},
    ],
    "error_logs": [
        {"words": ["exception", "error", "catch", "try"], "each": 3, "cap": 15},
        {"words": ["traceback", "stacktrace", "stack_trace", "tostring"], "each": 2, "cap": 10},
        {"words": ["json", "structured", "context"], "each": 2, "cap": 10},
    ],
    "http_codes": [
        {"regex": [r"2\d{2}", "ok", "created", "accepted"], "each": 2, "cap": 10},
        {"regex": [r"4\d{2}", "badrequest", "unauthorized", "notfound"], "each": 2, "cap": 10},
        {"regex": [r"5\d{2}", "internalservererror", "badgateway"], "each": 2, "cap": 10},
    ],
    "ui_error_tools": [
        {"words": ["sentry"], "each": 20, "cap": 20, "flat": True},
        {"words": ["rollbar"], "each": 20, "cap": 20, "flat": True},
        {"words": ["bugsnag"], "each": 20, "cap": 20, "flat": True},
        {"words": ["airbrake"], "each": 20, "cap": 20, "flat": True},
    ],
    "automated_tests": [
        {"words": ["@test", "describe", "it(", "def test_", "assert"], "each": 2, "cap": 15},
        {"words": ["mock", "stub", "spy", "fake", "@mock", "mockito"], "each": 3, "cap": 10},
        {"words": ["assert", "expect", "should", "verify", "toequal", "tobe"], "each": 1, "cap": 10},
    ],
}

# Score bands.
MULTIPLIER_BANDS = [(90, 1.0), (80, 0.9), (70, 0.8), (60, 0.6)]
MULTIPLIER_ELSE = 0.4
TIER_BANDS = [(1.5, "CRITICAL"), (1.2, "HIGH"), (1.0, "MEDIUM")]
TIER_ELSE = "LOW"
VIEW_TIER_BANDS = [(1.8, "Critical Gates"), (1.4, "High Priority Gates")]
VIEW_TIER_ELSE = "Medium Priority Gates"
COVERAGE_SHARE, QUALITY_SHARE = 0.7, 0.3

# Text added to the project's recommendations when one of its first three failed gates is listed here.
FAILED_GATE_ADVICE = {
    "structured_logs": "Implement structured logging with JSON format and consistent fields",
    "retry_logic": "Add retry mechanisms with exponential backoff for I/O operations",
    "error_logs": "Ensure all exceptions are logged with proper context",
}
MANY_FAILURES_ISSUE = "Multiple gate failures detected (%d gates failed)"
MANY_FAILURES_ADVICE = "Focus on implementing basic logging and error handling first"
LOW_SCORE_ISSUE = "Overall gate coverage is critically low"
LOW_SCORE_ADVICE = "Consider implementing a gradual rollout of hard gates"
SECRETS_ISSUE = "Sensitive data detected in logs - security risk"
SECRETS_ADVICE = "Immediately audit and remove sensitive data from logs"

# Gates whose rows depend on what the project contains.
UI_GATES = ["ui_errors", "ui_error_tools"]
JOB_GATES = ["log_background_jobs"]

# Gates whose language result is lost when it has hits, in compatibility mode.
COMPAT_DROPPED_GATES = ["error_logs", "ui_errors", "http_codes", "ui_error_tools"]

# Ordered kinds of confidential data; the first that fits names a violation.
VIOLATION_KINDS = [
    ("Authentication & Tokens", "token auth bearer session csrf jwt".split()),
    ("Credentials & Passwords", "password secret key credential user login".split()),
    ("Financial Information", "card account bank credit cvv pin ssn iban".split()),
    ("Personal Information", "name email phone address birth dob".split()),
    ("API Keys & Service Credentials", "api_key apikey aws_ azure_ gcp_".split()),
    ("Database & Connection Info", "db_ database connection jdbc mongo".split()),
]
VIOLATION_OTHER = "Other"
EXAMPLE_KINDS = ["Authentication & Tokens", "Credentials & Passwords", "API Keys & Service Credentials"]

# Kinds counted together (a hit may count in several) and their weights.
VIOLATION_WEIGHTS = [
    ("authentication", "token auth bearer session csrf jwt".split(), -15),
    ("credentials", "password secret key credential user login".split(), -12),
    ("financial", "card account bank credit cvv pin ssn".split(), -8),
    ("personal", "name email phone address birth dob".split(), -5),
    ("api_keys", "api_key apikey aws_ azure_ gcp_".split(), -10),
]

# Detail facets per gate: (label, words). A label shows when a hit's matched text contains a word;
# ``raw`` words are looked for without lower-casing.
HIT_KINDS = {
    "correlation_id": [("correlation_id", ["correlation"]), ("request_id", ["request"]), ("trace_id", ["trace"])],
    "log_background_jobs": [("Celery", ["celery"]), ("Scheduled", ["scheduled"]), ("Cron", ["cron"]),
                            ("Queue", ["queue"])],
    "retry_logic": [("Decorator-based", ["decorator", "@"]), ("Loop-based", ["loop", "for"]),
                    ("Library-based", ["library"])],
    "timeouts": [("Connection", ["connect"]), ("Read", ["read"]), ("Request", ["request"])],
    "throttling": [("Decorator-based", ["@"]), ("Middleware-based", ["middleware"]),
                   ("Library-based", ["library"])],
    "circuit_breakers": [("Resilience4j", ["resilience4j"]), ("Hystrix", ["hystrix"]), ("Polly", ["polly"]),
                         ("Opossum", ["opossum"])],
    "error_logs": [("Exception handling", ["exception"]), ("Try-catch blocks", ["catch"]),
                   ("Error throwing", ["throw"])],
    "automated_tests": [("Unit tests", ["unit"]), ("Integration tests", ["integration"]),
                        ("End-to-end tests", ["e2e", "end-to-end"]), ("Mocked tests", ["mock"]),
                        ("pytest", ["pytest"]), ("JUnit", ["junit"]), ("Jest", ["jest"]), ("Mocha", ["mocha"]),
                        ("NUnit", ["nunit"])],
}
# In Loop-based the word "for" and in Decorator-based the sign "@" are looked for in the unchanged text.
RAW_WORDS = ["@", "for"]

ERROR_TOOLS = ["Sentry", "Rollbar", "Bugsnag", "Airbrake"]
STATUS_CODE_PATTERN = r"\b[2-5]\d{2}\b"

# Words that make a code sample relevant to a gate (gates not listed keep all samples).
SAMPLE_WORDS = {
    "structured_logs": ["log", "logger", "logging", "json", "structured", "extra", "format"],
    "avoid_logging_secrets": ["password", "token", "secret", "api_key", "log", "credential", "auth"],
    "audit_trail": ["audit", "log", "track", "history", "event", "record"],
    "correlation_id": ["correlation", "request_id", "trace_id", "uuid", "x-correlation"],
    "error_logs": ["error", "exception", "log", "catch", "try", "except", "raise"],
    "retry_logic": ["retry", "attempt", "backoff", "exponential", "sleep", "time.sleep"],
    "timeouts": ["timeout", "deadline", "duration", "time", "sleep", "wait"],
    "circuit_breakers": ["circuit", "breaker", "fallback", "threshold", "failure"],
    "throttling": ["throttle", "rate", "limit", "quota", "sleep", "delay"],
    "automated_tests": ["test", "assert", "mock", "spec", "it(", "describe(", "unittest", "pytest"],
    "http_codes": ["status", "code", "http", "200", "404", "500", "response", "status_code"],
    "log_api_calls": ["api", "endpoint", "request", "response", "log", "method"],
    "ui_errors": ["error", "exception", "alert", "message", "ui", "user"],
}
BATCH_HIGH = ["structured_logs", "avoid_logging_secrets", "error_logs", "audit_trail"]
BATCH_MEDIUM = ["correlation_id", "retry_logic", "timeouts", "circuit_breakers", "automated_tests"]
