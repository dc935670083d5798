"""The regular expressions each gate looks for, one per line, by language.

TypeScript uses the JavaScript text. The pack for secrets in logs is built from a rule in
``secret_words.py`` and ``rules.py``. Matching ignores case.
"""

PACKS = {
    "structured_logs": {
        "python": r'''
logger\.info\s*\(\s*["\'][^"\']*["\']],?\s*extra\s*=
logger\.error\s*\(\s*["\'][^"\']*["\']],?\s*extra\s*=
logger\.warning\s*\(\s*["\'][^"\']*["\']],?\s*extra\s*=
structlog\.get_logger\s*\(
logging\.getLogger\s*\([^)]*\)\.info\s*\([^)]*\{
json\.dumps\s*\([^)]*\)\s*.*logger
logger\.\w+\s*\([^)]*json\.
''',
        "java": r'''
logger\.info\s*\(\s*["\'][^"\']*\{\}[^"\']*["\']
logger\.error\s*\(\s*["\'][^"\']*\{\}[^"\']*["\']
Markers\.\w+\(
MDC\.put\s*\(
StructuredArguments\.\w+\(
@Slf4j.*@JsonLog
ObjectMapper\s*\(\)\.writeValueAsString
''',
        "javascript": r'''
console\.log\s*\(\s*JSON\.stringify\s*\(
logger\.info\s*\(\s*\{[^}]*\}
winston\.createLogger\s*\(
bunyan\.createLogger\s*\(
pino\s*\(\s*\{
log\.\w+\s*\(\s*\{[^}]*\}
''',
        "csharp": r'''
_logger\.LogInformation\s*\([^)]*\{[^}]*\}
_logger\.LogError\s*\([^)]*\{[^}]*\}
ILogger<\w+>
Serilog\.Log\.\w+\s*\([^)]*\{[^}]*\}
LogContext\.PushProperty\s*\(
Log\.ForContext\s*\(
''',
    },
    "audit_trail": {
        "python": r'''
audit_logger\.
log.*audit
logger\.info.*\b(create|update|delete|login|logout)\b
logger\.info.*\b(admin|user|access)\b
security_log\.
access_log\.
''',
        "java": r'''
auditLogger\.
log.*audit
logger\.info.*\b(create|update|delete|login|logout)\b
SecurityContextHolder\.
@Audit
AuditEvent\(
''',
        "javascript": r'''
auditLog\.
log.*audit
logger\.info.*\b(create|update|delete|login|logout)\b
audit\.
securityLog\.
''',
        "csharp": r'''
_auditLogger\.
Log.*audit
_logger\.LogInformation.*\b(Create|Update|Delete|Login|Logout)\b
AuditLog\.
\[Audit\]
''',
    },
    "correlation_id": {
        "python": r'''
correlation_id
request_id
trace_id
transaction_id
x-correlation-id
x-request-id
uuid\.uuid4\(\)
threading\.local\(\)
''',
        "java": r'''
correlationId
requestId
traceId
MDC\.put\s*\(\s*["\']correlation
MDC\.put\s*\(\s*["\']request
UUID\.randomUUID\(\)
ThreadLocal
''',
        "javascript": r'''
correlationId
requestId
traceId
x-correlation-id
x-request-id
uuid\.v4\(\)
crypto\.randomUUID\(\)
''',
        "csharp": r'''
CorrelationId
RequestId
TraceId
Guid\.NewGuid\(\)
Activity\.Current
HttpContext\.TraceIdentifier
''',
    },
    "log_api_calls": {
        "python": r'''
@app\.route.*\n.*logger\.
@router\.\w+.*\n.*logger\.
def \w+.*request.*:.*\n.*logger\.
logger\.info.*request
logger\.info.*response
logger\.info.*endpoint
access_log\.
''',
        "java": r'''
@RequestMapping.*\n.*logger\.
@GetMapping.*\n.*logger\.
@PostMapping.*\n.*logger\.
@RestController.*\n.*logger\.
logger\.info.*request
logger\.info.*response
logger\.info.*endpoint
''',
        "javascript": r'''
app\.\w+\s*\([^)]*,.*logger\.
router\.\w+\s*\([^)]*,.*logger\.
express\(\).*logger\.
logger\.info.*request
logger\.info.*response
console\.log.*req\.
console\.log.*res\.
''',
        "csharp": r'''
\[HttpGet\].*\n.*_logger\.
\[HttpPost\].*\n.*_logger\.
\[Route.*\].*\n.*_logger\.
_logger\.LogInformation.*request
_logger\.LogInformation.*response
_logger\.LogInformation.*endpoint
''',
    },
    "log_background_jobs": {
        "python": r'''
celery.*logger\.
@task.*\n.*logger\.
@periodic_task.*\n.*logger\.
job_logger\.
logger\.info.*job
logger\.info.*task
logger\.info.*worker
scheduler\.
''',
        "java": r'''
@Scheduled.*\n.*logger\.
@Component.*Job.*\n.*logger\.
Quartz.*logger\.
logger\.info.*job
logger\.info.*task
logger\.info.*scheduled
JobExecutionContext
''',
        "javascript": r'''
cron\.
setInterval.*logger\.
setTimeout.*logger\.
queue\.
worker\.
logger\.info.*job
logger\.info.*task
''',
        "csharp": r'''
IHostedService.*_logger\.
BackgroundService.*_logger\.
Timer.*_logger\.
_logger\.LogInformation.*job
_logger\.LogInformation.*task
Hangfire\.
''',
    },
    "ui_errors": {
        "python": r'''
@app\.errorhandler\s*\(
@bp\.errorhandler\s*\(
flask\.abort\s*\(
render_template.*error
flash\s*\([^)]*error
return.*error.*template
''',
        "java": r'''
@ExceptionHandler
@ControllerAdvice
ModelAndView.*error
return.*error.*view
ResponseEntity\..*error
@ErrorPage
''',
        "javascript": r'''
componentDidCatch\s*\(
ErrorBoundary
try.*catch.*setState.*error
\.catch.*setError
useState.*error
error.*state
window\.onerror
addEventListener.*error
''',
        "csharp": r'''
\[ExceptionFilter\]
IExceptionHandler
HandleErrorAsync
return.*View.*Error
ViewResult.*Error
RedirectToAction.*Error
''',
    },
    "retry_logic": {
        "python": r'''
@retry\s*\(
@backoff\.
for\s+attempt\s+in\s+range\s*\(
while\s+retries\s*<
time\.sleep\s*\(
retrying\.
tenacity\.
retry_count\s*=
max_retries\s*=
exponential_backoff
requests\.adapters\.HTTPAdapter.*retry
urllib3\.util\.retry\.Retry
''',
        "java": r'''
@Retryable
@Retry
RetryTemplate
Retryer\.newBuilder\(\)
for\s*\(\s*int\s+retries\s*=
while\s*\(\s*retries\s*<
Thread\.sleep\s*\(
TimeUnit\.\w+\.sleep\s*\(
maxRetries\s*=
retryCount\s*=
exponentialBackoff
RetryPolicy
''',
        "javascript": r'''
retry\s*\(
p-retry
async-retry
for\s*\(\s*let\s+attempt\s*=
while\s*\(\s*retries\s*<
setTimeout\s*\(
delay\s*\(
maxRetries\s*:
retryCount\s*:
exponentialBackoff
backoff\s*:
''',
        "csharp": r'''
\[Retry\]
Polly\.
RetryPolicy
for\s*\(\s*int\s+retries\s*=
while\s*\(\s*retries\s*<
Task\.Delay\s*\(
Thread\.Sleep\s*\(
MaxRetries\s*=
RetryCount\s*=
ExponentialBackoff
WaitAndRetry
''',
    },
    "timeouts": {
        "python": r'''
timeout\s*=\s*\d+
requests\.get\s*\([^)]*timeout\s*=
requests\.post\s*\([^)]*timeout\s*=
urllib\.request\.[^(]*timeout\s*=
socket\.settimeout\s*\(
asyncio\.wait_for\s*\(
concurrent\.futures\.[^(]*timeout\s*=
@timeout\s*\(
signal\.alarm\s*\(
threading\.Timer\s*\(
''',
        "java": r'''
setTimeout\s*\(
setConnectTimeout\s*\(
setReadTimeout\s*\(
timeout\s*=\s*\d+
TimeUnit\.\w+\s*,\s*\d+
@Timeout\s*\(
CompletableFuture\.get\s*\([^)]*TimeUnit
ExecutorService.*timeout
HttpClient.*timeout
RestTemplate.*timeout
''',
        "javascript": r'''
setTimeout\s*\(
timeout\s*:\s*\d+
axios\.[^(]*timeout\s*:
fetch\s*\([^)]*timeout
AbortController\s*\(
signal\s*:\s*AbortSignal
Promise\.race\s*\(
setInterval\s*\(
clearTimeout\s*\(
request\.[^(]*timeout
''',
        "csharp": r'''
Timeout\s*=\s*\d+
HttpClient.*Timeout
CancellationToken\.
Task\.Delay\s*\(
Task\.WaitAll\s*\([^)]*TimeSpan
Task\.WaitAny\s*\([^)]*TimeSpan
ManualResetEvent.*timeout
AutoResetEvent.*timeout
SemaphoreSlim.*timeout
Timer\s*\(
''',
    },
    "throttling": {
        "python": r'''
@throttle\s*\(
@rate_limit\s*\(
RateLimiter\s*\(
TokenBucket\s*\(
time\.sleep\s*\(
rate_limit\s*=
throttle\s*=
slowapi\.
flask_limiter\.
ratelimit\s*\(
''',
        "java": r'''
@RateLimited
@Throttle
RateLimiter\.
Semaphore\s*\(
Thread\.sleep\s*\(
rateLimit\s*=
throttle\s*=
bucket4j\.
guava.*RateLimiter
resilience4j.*RateLimiter
''',
        "javascript": r'''
throttle\s*\(
rateLimit\s*\(
express-rate-limit
express-slow-down
bottleneck\.
p-throttle
setTimeout\s*\(
setInterval\s*\(
rate.*limit
throttle.*middleware
''',
        "csharp": r'''
\[RateLimit\]
\[Throttle\]
SemaphoreSlim\s*\(
RateLimiter\.
Task\.Delay\s*\(
Thread\.Sleep\s*\(
RateLimit\s*=
Throttle\s*=
AspNetCoreRateLimit
FirewallRules
''',
    },
    "circuit_breakers": {
        "python": r'''
@circuit_breaker\s*\(
CircuitBreaker\s*\(
pybreaker\.
circuit.*breaker
failure_threshold\s*=
recovery_timeout\s*=
half_open\s*=
@circuitbreaker
breaker\s*=
state.*OPEN
''',
        "java": r'''
@CircuitBreaker
CircuitBreaker\.
resilience4j\.circuitbreaker
hystrix\.
@HystrixCommand
failureThreshold\s*=
recoveryTimeout\s*=
halfOpenAfter\s*=
CircuitBreakerConfig\.
State\.OPEN
''',
        "javascript": r'''
CircuitBreaker\s*\(
opossum\.
circuit.*breaker
failureThreshold\s*:
timeout\s*:
resetTimeout\s*:
halfOpen\s*:
breaker\s*=
state.*OPEN
fallback\s*:
''',
        "csharp": r'''
\[CircuitBreaker\]
CircuitBreaker\.
Polly\.CircuitBreaker
FailureThreshold\s*=
DurationOfBreak\s*=
CircuitBreakerPolicy
State\.Open
State\.HalfOpen
HandleResult\s*<
OrResult\s*<
''',
    },
    "error_logs": {
        "python": r'''
except\s+\w+.*:.*\n.*logger\.
except\s+Exception.*:.*\n.*logger\.
try:.*\n.*except.*:.*\n.*log
logger\.error\s*\(
logger\.exception\s*\(
logging\.error\s*\(
logging\.exception\s*\(
raise.*\n.*logger\.
traceback\.format_exc\(\)
sys\.exc_info\(\)
''',
        "java": r'''
catch\s*\([^)]*Exception[^)]*\).*\{.*\n.*logger\.
catch\s*\([^)]*\).*\{.*\n.*log\.
logger\.error\s*\(
log\.error\s*\(
throw new.*Exception.*\n.*logger\.
printStackTrace\(\)
ExceptionUtils\.getStackTrace\(
@ExceptionHandler
@ControllerAdvice
''',
        "javascript": r'''
catch\s*\([^)]*\).*\{.*\n.*console\.error
catch\s*\([^)]*\).*\{.*\n.*logger\.
\.catch\s*\([^)]*\).*=>.*console\.error
\.catch\s*\([^)]*\).*=>.*logger\.
console\.error\s*\(
logger\.error\s*\(
throw new Error.*\n.*console\.
throw new Error.*\n.*logger\.
process\.on\s*\(\s*["\']uncaughtException
window\.onerror\s*=
''',
        "csharp": r'''
catch\s*\([^)]*Exception[^)]*\).*\{.*\n.*_logger\.
catch\s*\([^)]*\).*\{.*\n.*Log\.
_logger\.LogError\s*\(
Log\.Error\s*\(
throw new.*Exception.*\n.*_logger\.
ex\.ToString\(\)
ex\.StackTrace
\[ExceptionFilter\]
IExceptionHandler
''',
    },
    "http_codes": {
        "python": r'''
return.*status_code\s*=\s*\d{3}
abort\s*\(\s*\d{3}
HTTPException\s*\(\s*status_code\s*=\s*\d{3}
Response\s*\([^)]*status\s*=\s*\d{3}
status\s*=\s*HTTP_\d+
return.*\d{3}
''',
        "java": r'''
ResponseEntity\.\w+\(\)
HttpStatus\.\w+
@ResponseStatus\s*\([^)]*\d{3}
response\.setStatus\s*\(\s*\d{3}
return.*status\s*\(\s*\d{3}
ResponseEntity\.status\s*\(\s*\d{3}
''',
        "javascript": r'''
res\.status\s*\(\s*\d{3}
response\.status\s*=\s*\d{3}
\.status\s*\(\s*\d{3}\)
statusCode\s*:\s*\d{3}
return.*status\s*:\s*\d{3}
throw.*status\s*:\s*\d{3}
''',
        "csharp": r'''
return.*StatusCode\s*\(\s*\d{3}
HttpStatusCode\.\w+
return.*Ok\s*\(\)
return.*BadRequest\s*\(
return.*NotFound\s*\(
return.*Unauthorized\s*\(
Response\.StatusCode\s*=\s*\d{3}
''',
    },
    "ui_error_tools": {
        "python": r'''
import sentry_sdk
sentry_sdk\.init
sentry_sdk\.capture_exception
import rollbar
rollbar\.init
import bugsnag
bugsnag\.configure
import airbrake
from honeybadger import honeybadger
''',
        "java": r'''
import.*sentry
Sentry\.init
Sentry\.captureException
import.*rollbar
import.*bugsnag
import.*airbrake
@SentryTransaction
''',
        "javascript": r'''
import.*@sentry
Sentry\.init
Sentry\.captureException
import.*rollbar
import.*bugsnag
import.*@bugsnag
import.*airbrake
ErrorBoundary.*Sentry
''',
        "csharp": r'''
using Sentry
SentrySdk\.Init
SentrySdk\.CaptureException
using Rollbar
using Bugsnag
using Airbrake
''',
    },
    "automated_tests": {
        "python": r'''
def\s+test_\w+\s*\(
class\s+Test\w+\s*\(
@pytest\.
@unittest\.
@mock\.
assert\s+\w+
assertEqual\s*\(
assertTrue\s*\(
assertFalse\s*\(
assertRaises\s*\(
pytest\.raises\s*\(
unittest\.TestCase
from\s+unittest\s+import
import\s+pytest
import\s+unittest
mock\.patch\s*\(
@patch\s*\(
TestCase\s*\(
''',
        "java": r'''
@Test\s*$
@Test\s*\(
@BeforeEach
@AfterEach
@BeforeAll
@AfterAll
@Mock\s*$
@MockBean
@InjectMocks
@ExtendWith\s*\(
@SpringBootTest
@WebMvcTest
@DataJpaTest
assertEquals\s*\(
assertTrue\s*\(
assertFalse\s*\(
assertThrows\s*\(
Mockito\.
when\s*\(
verify\s*\(
MockMvc\s+
TestRestTemplate
''',
        "javascript": r'''
describe\s*\(
it\s*\(
test\s*\(
expect\s*\(
beforeEach\s*\(
afterEach\s*\(
beforeAll\s*\(
afterAll\s*\(
jest\.
sinon\.
chai\.
assert\.
should\.
\.toBe\s*\(
\.toEqual\s*\(
\.toHaveBeenCalled
\.toThrow\s*\(
mount\s*\(
shallow\s*\(
render\s*\(
fireEvent\.
screen\.
''',
        "csharp": r'''
\[Test\]
\[TestMethod\]
\[Fact\]
\[Theory\]
\[SetUp\]
\[TearDown\]
\[TestInitialize\]
\[TestCleanup\]
Assert\.
Should\.
Expect\.
Mock\.
Verify\s*\(
Setup\s*\(
Returns\s*\(
TestContext\s+
TestFixture
NUnit\.
MSTest\.
xUnit\.
''',
    },
}
