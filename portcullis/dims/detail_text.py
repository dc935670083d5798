"""What the details of a gate say.

``none`` stands alone without hits. ``head`` and ``files`` name the hits and the files with hits, ``kinds`` the labels of
``dims.gates.HIT_KINDS`` (how many of them, under which title), ``tech`` the title above technologies.
"""

DETAILS = {
    "structured_logs": {
        "none": "No structured logging patterns found",
        "files": "Found structured logging in %d files",
        "longest": "  %s: %d structured log statements",
        "tech": "\n📊 Detected Technologies:",
    },
    "avoid_logging_secrets": {
        "none": "✅ No confidential data logging patterns detected",
        "head": "🚨 Found %d potential confidential data logging violations:",
    },
    "audit_trail": {
        "none": "No audit trail logging patterns found",
        "head": "Found %d audit logging statements",
        "files": "Audit logging present in %d files",
    },
    "correlation_id": {
        "none": "No correlation ID patterns found",
        "head": "Found %d correlation ID implementations",
        "kinds": [(3, "Types found")],
    },
    "log_api_calls": {"none": "No API logging patterns found", "head": "Found %d API logging statements"},
    "log_background_jobs": {
        "none": "No background job logging patterns found",
        "head": "Found %d background job logging statements",
        "kinds": [(4, "Job types found")],
    },
    "ui_errors": {
        "none": "No UI error handling patterns found",
        "head": "Found %d UI error handling implementations",
        "tech": "\n🎨 Detected Technologies:",
    },
    "retry_logic": {
        "none": "No retry logic patterns found",
        "head": "Found %d retry logic implementations",
        "kinds": [(3, "Retry types found")],
    },
    "timeouts": {"none": "No timeout patterns found", "head": "Found %d timeout configurations", "kinds": [(3, "Timeout types found")]},
    "throttling": {
        "none": "No throttling patterns found",
        "head": "Found %d throttling implementations",
        "kinds": [(3, "Throttling types found")],
    },
    "circuit_breakers": {
        "none": "No circuit breaker patterns found",
        "head": "Found %d circuit breaker implementations",
        "kinds": [(4, "Circuit breaker libraries found")],
    },
    "error_logs": {
        "none": "No error logging patterns found",
        "head": "Found %d error logging implementations",
        "files": "Error logging present in %d files",
        "kinds": [(3, "Error handling types")],
        "tech": "\n🔧 Detected Technologies:",
    },
    "http_codes": {
        "none": "No HTTP status code patterns found",
        "head": "Found %d HTTP status code implementations",
        "tech": "\n🌐 Detected Technologies:",
    },
    "ui_error_tools": {
        "none": "No error monitoring tools found",
        "head": "Found %d error monitoring tool implementations",
        "tech": "\n📊 Detected Technologies:",
    },
    "automated_tests": {
        "none": "No automated test patterns found",
        "head": "Found %d test implementations",
        "kinds": [(4, "Test types found"), (5, "Test frameworks found")],
    },
}
REQUESTS, RESPONSES = "Request logging: %d instances", "Response logging: %d instances"
CODES_USED, TOOLS_FOUND = "Status codes used: ", "Tools detected: "
BY_CATEGORY, EXAMPLES = "\n📊 Violations by Category:", "\n🔍 Examples of violations found:"
VIOLATION_BANDS, VIOLATION_BAND_ELSE = [(5, "🔴 CRITICAL"), (2, "🟡 HIGH")], "🟠 MEDIUM"
MORE_VIOLATIONS = "  ... and %d more violations"
WARNING = "\n⚠️  These violations pose serious security risks and should be addressed immediately!"
MATCHES = "Found %d pattern matches:"
MATCHES_OF_FILE, MATCH, PATTERN, MORE_MATCHES = "📁 %s:", "   Line %d: %s", "   Pattern: %s", "   ... and %d more matches"
NOT_APPLICABLE, NO_ACTION = "Gate %s is not applicable to this project type", "No action needed - %s not relevant for this project"
