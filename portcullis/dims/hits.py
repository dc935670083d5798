"""How a hit is graded and what is said about it."""

SEVERITY_WORDS = [
    ("HIGH", ["password", "secret", "token", "key", "auth", "credential", "sql injection", "xss"]),
    ("MEDIUM", ["error", "exception", "warning", "deprecated", "todo", "fixme"]),
    ("LOW", ["log", "debug", "info", "trace"]),
]
SEVERITY_ELSE = "MEDIUM"
BASE_PRIORITY = {"HIGH": 8, "MEDIUM": 5, "LOW": 2}
RAISING_NAMES = ["main", "public", "api", "controller"]
LOWERING_NAMES = ["test", "spec", "mock"]

PATTERN_TYPES = [
    ("logging", ["log", "logger", "console", "print", "debug"]),
    ("error_handling", ["try", "catch", "except", "error", "exception"]),
    ("security", ["password", "token", "secret", "auth", "credential"]),
    ("database", ["sql", "query", "select", "insert", "update", "delete"]),
    ("api", ["http", "rest", "api", "endpoint", "request", "response"]),
    ("testing", ["test", "assert", "mock", "spec", "should"]),
    ("configuration", ["config", "setting", "property", "env"]),
    ("monitoring", ["metric", "trace", "span", "monitor", "alert"]),
]
PATTERN_TYPE_ELSE = "general"
CATEGORY_SUFFIXES = ["structured", "async", "error"]

#: Advice for a pattern: the first row applies of whose words the pattern holds one and of whose others it holds none.
FIXES = [
    ("Remove sensitive data from logs. Use placeholder values or hash sensitive information.", ["password", "secret"], []),
    ("Consider using structured logging with appropriate log levels.", ["log"], ["error"]),
    ("Ensure proper error handling with specific exception types and logging.", ["try", "catch"], []),
    ("Address this TODO/FIXME item before production deployment.", ["todo", "fixme"], []),
]
FIX_ELSE = "Review this code pattern for compliance with best practices."

DOC_LINKS = {
    "logging": "https://docs.example.com/logging-best-practices",
    "error_handling": "https://docs.example.com/error-handling",
    "security": "https://docs.example.com/security-guidelines",
    "testing": "https://docs.example.com/testing-standards",
    "api": "https://docs.example.com/api-design",
}
DOC_LINK_ELSE = "https://docs.example.com/coding-standards"

COMMENT_STARTS = ["#", "//", "/*", "*"]
