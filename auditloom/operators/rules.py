"""The detection rules as data: each rule is an id, its rating and one Column predicate.

A predicate receives a :class:`Line` and is compiled into a single projection
over the candidate lines of a file, so all rules share one read of the content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.regex import has, has_cs
from auditloom.functions.text import SECRET_ASSIGNMENT, URL_LOGIN, constant_array
from auditloom.operators import fixed_values as V


class Line:
    """Accessors for one candidate line inside the rule projection."""

    def __init__(self, row: Column, flags_used: set[str]):
        self.row = row
        self.flags_used = flags_used
        self.text = row["text"]
        self.trimmed = row["trimmed"]
        self.is_comment = row["is_comment"]
        self.low = row["low"]
        self.user_input = row["user_input"]
        self.joined = row["joined"]

    def flag(self, name: str) -> Column:
        self.flags_used.add(name)
        return F.col(name)

    def has(self, pattern: str) -> Column:
        return has(self.text, pattern)

    def has_cs(self, pattern: str) -> Column:
        return has_cs(self.text, pattern)

    def trim_has(self, pattern: str) -> Column:
        return has(self.trimmed, pattern)

    def trim_has_cs(self, pattern: str) -> Column:
        return has_cs(self.trimmed, pattern)

    def following(self, count: int, sep: str) -> Column:
        """This line and the next ``count - 1`` ones."""
        return F.array_join(F.slice(F.col("lines"), self.row["line"], count), sep)


@dataclass(frozen=True)
class Rule:
    """One way a rule can fire; several entries may share a ``rule_id``.

    ``key`` names what identifies a finding besides rule and path: ``L`` the
    line text, ``C`` category and line text, ``F`` nothing (one per file), ``R``
    the repository and a tag. ``scope`` is ``line`` (every matching line),
    ``first`` (first matching line of a file), ``file`` or ``repo``.
    """

    rule_id: str
    family: str
    analyzer: str
    category: str
    severity: str
    confidence: str
    key: str
    title: str
    scope: str = "line"
    when: Callable[[Line], Column] | None = None
    subcategory: str | None = None
    tag: str = ""
    words: tuple[str, ...] = ()


def _sql(ln: Line) -> Column:
    bound = ln.has_cs(V.SQL_PLACEHOLDER) & (ln.has_cs(V.SQL_LIST) | ln.has(V.SQL_BIND_WORD))
    dynamic = ln.joined | ln.text.contains('f"')
    return ln.flag("is_code") & ln.user_input & dynamic & ln.has(V.SQL_CONTEXT) & ~bound


def _exec(ln: Line) -> Column:
    return ln.flag("is_code") & ln.has(V.PROCESS_EXEC)


def _static_command(ln: Line) -> Column:
    return ln.trim_has_cs(V.STATIC_COMMAND) | ~ln.has_cs(V.SHELL_DYNAMIC_MARK)


def _xss(ln: Line) -> Column:
    return ln.flag("is_js") & ln.has(V.HTML_SINK) & ~(ln.has(V.HTML_CLEANER) | ln.trim_has(V.STATIC_HTML))


def _bola(ln: Line) -> Column:
    nearby = ln.following(30, "\n")
    return ln.flag("is_code") & ln.has(V.SENSITIVE_ROUTE) & has(nearby, V.NEARBY_AUTH) & ~has(nearby, V.OWNER_CHECK)


def _jwt_no_expiry(ln: Line) -> Column:
    return ln.flag("is_code") & ln.has(V.JWT_SIGN) & ~has(ln.following(10, " "), V.JWT_EXPIRY)


def _cookie(ln: Line) -> Column:
    unset = ~ln.text.contains("httpOnly") & ~ln.flag("has_http_only")
    return ln.flag("is_code") & ln.has(V.COOKIE_SET) & (ln.has(V.HTTP_ONLY_OFF) | unset)


def _cors_wildcard(ln: Line) -> Column:
    return ln.flag("is_code_json") & ln.has(V.CORS_WILDCARD) & ln.flag("has_credentials")


def _cors_reflected(ln: Line) -> Column:
    reflected = ln.has(V.CORS_REFLECTED_HEADER) | ln.has(V.CORS_REFLECTED_OPTION)
    return ln.flag("is_code_json") & reflected & ~(ln.has(V.CORS_WILDCARD) & ln.flag("has_credentials"))


def _api(pattern: str) -> Callable[[Line], Column]:
    return lambda ln: ln.flag("is_code") & ~ln.is_comment & ln.has(pattern)


def _api_cors(ln: Line) -> Column:
    wildcard = ln.has(V.CORS_CALL_WILDCARD) | ln.has(V.CORS_HEADER_WILDCARD) | ln.has(V.CORS_MIDDLEWARE_WILDCARD)
    return ln.flag("is_code") & ~ln.is_comment & wildcard


def _logged(ln: Line) -> Column:
    return ln.flag("is_code") & ~ln.flag("log_skipped") & ~ln.is_comment


def _env_logged(ln: Line) -> Column:
    return ln.trim_has(V.ENV_LOGGED_JS) | ln.trim_has(V.ENV_LOGGED_PY)


def _credential_logged(ln: Line) -> Column:
    status_only = ln.trim_has(V.STATUS_MESSAGE) & ~ln.trim_has(V.LOGGED_ARGUMENT)
    return _logged(ln) & ln.trim_has(V.CREDENTIAL_LOGGED) & ~_env_logged(ln) & ~status_only


def _js_code(*patterns: str) -> Callable[[Line], Column]:
    def when(ln: Line) -> Column:
        found = ln.trim_has(patterns[0])
        for p in patterns[1:]:
            found = found | ln.trim_has(p)
        return ln.flag("is_unsafe_ext") & ~ln.flag("is_python") & ~ln.is_comment & found

    return when


def _py_code(pattern: str) -> Callable[[Line], Column]:
    return lambda ln: ln.flag("is_unsafe_ext") & ln.flag("is_python") & ~ln.is_comment & ln.trim_has(pattern)


def _debug_on(ln: Line) -> Column:
    place = ln.flag("config_path") | ln.flag("prod_path") | ln.flag("is_python")
    on = ln.trim_has_cs(V.DEBUG_FLAG) | ln.trim_has_cs(V.DEBUG_JSON)
    return place & ~ln.is_comment & ~ln.flag("test_path") & on


def _cookie_flags(ln: Line) -> Column:
    found = ln.trim_has(V.COOKIE_FLAGS[0])
    for p in V.COOKIE_FLAGS[1:]:
        found = found | ln.trim_has(p)
    return found


def _reliable(ln: Line) -> Column:
    return ln.flag("is_reliability") & ~ln.flag("rel_test_doc")


def _swallowed(ln: Line) -> Column:
    return ln.flag("is_reliability") & (
        ln.has_cs(V.EMPTY_CATCH)
        | (ln.text.contains("catch") & ln.text.endswith("{}"))
        | ln.has_cs(V.EXCEPT_PASS)
        | ln.has_cs(V.EXCEPT_TYPE_PASS)
    )


def _no_timeout(ln: Line) -> Column:
    call = ln.has_cs(V.HTTP_CALL_JS) | ln.has_cs(V.HTTP_CALL_PY)
    return _reliable(ln) & call & ~ln.text.contains("timeout") & ~ln.text.contains("signal")


def _unhandled_promise(ln: Line) -> Column:
    """No ``.catch(`` from the first occurrence of this line's text to the end of the file.

    That is the case iff the last ``.catch(`` of the file starts before that occurrence.
    """
    last = ln.flag("last_catch")
    handled = (last > 0) & (last >= F.position(ln.text, F.col("content")))
    return _reliable(ln) & ln.text.contains(".then(") & ~ln.text.contains(".catch(") & ~handled


def _ci(pattern: str, trimmed: bool = False, ignore_case: bool = True) -> Callable[[Line], Column]:
    def when(ln: Line) -> Column:
        target = ln.trimmed if trimmed else ln.text
        return ln.flag("is_ci") & (has(target, pattern) if ignore_case else has_cs(target, pattern))

    return when


def _docker(pattern: str, ignore_case: bool = True) -> Callable[[Line], Column]:
    return lambda ln: ln.flag("is_dockerfile") & (
        ln.trim_has(pattern) if ignore_case else ln.trim_has_cs(pattern)
    )


# For each line rule, lower-case words of which a matching line holds at least one. A
# substring search is far cheaper than a pattern, so it runs first; it decides
# nothing on its own. tests/test_rules.py checks that results without it agree.
_LOGGERS = ("console.", "logger.", "logging.")
WORDS: dict[str, tuple[str, ...]] = {
    "SECRET-001": (
        "audit_test_", "sk_", "sk-", "pk_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "aiza", "akia", "sg.",
    ),
    "SECRET-002": ("://",),
    "SECRET-003": ("key", "secret", "token", "passw"),
    "SECRET-004": ("-----begin",),
    "SECRET-005": ("eyj",),
    "CONFIG-002": ("localhost", "127.0.0.1"),
    "CONFIG-003": ("debug",),
    "CONFIG-004": ("next_public_", "vite_", "react_app_"),
    "CONFIG-006": ("httponly", "secure", "samesite"),
    "API-002": ("readfile", "sendfile", "open"),
    "API-003": ("redirect",),
    "API-004": ("cors", "access-control-allow-origin"),
    "API-005": ("json",),
    "AUTH-001": ("role", "isadmin"),
    "AUTH-003": ("jwt.verify", "jwt.decode"),
    "AUTH-004": ("password",),
    "AUTH-005": ("jwt.sign",),
    "AUTH-006": ("res.cookie",),
    "CODE-001": ("eval",),
    "CODE-002": ("function",),
    "CODE-003": ("exec",),
    "CODE-004": ("query", "execute", "raw"),
    "CODE-005": ("innerhtml",),
    "CODE-006": ("eval", "exec"),
    "CODE-007": ("subprocess", "os.system"),
    "CODE-008": (".execute",),
    "CODE-009": ("pickle", "yaml.load"),
    "LOG-001": _LOGGERS,
    "LOG-002": ("json",),
    "LOG-003": _LOGGERS,
    "SQL-001": ("req", "params"),
    "CMD-001": ("exec", "spawn", "os.system", "subprocess"),
    "CMD-002": ("exec", "spawn", "os.system", "subprocess"),
    "PATH-001": ("fs.", "open"),
    "SSRF-001": ("fetch", "axios.", "requests.", "urllib"),
    "XSS-001": ("innerhtml", "document.write"),
    "AUTHZ-001": ("req",),
    "AUTHZ-002": ("app.", "router."),
    "CORS-001": ("origin",),
    "CORS-002": ("origin",),
    "ERR-001": ("res.", "response."),
    "CFG-002": ("debug", "node_env"),
    "CFG-003": ("localhost",),
    "REL-001": ("sync",),
    "REL-002": ("fetch", "axios", "http.get", "https.get", "requests."),
    "REL-003": ("catch", "except"),
    "REL-004": (".then(",),
    "REL-006": ("cache", "queue", "store", "logs", "history", "buffer"),
    "DAT-001": _LOGGERS,
    "DAT-002": ("app.get", "req.query"),
    "DAT-003": ("res.json", "res.send"),
}


def _rules() -> list[Rule]:
    out: list[Rule] = []

    def add(rule_id, severity, confidence, title, when=None, scope="line", tag=""):
        family, analyzer, category, key, sub = group
        out.append(
            Rule(
                rule_id, family, analyzer, category, severity, confidence, key, title, scope, when, sub, tag,
                WORDS.get(rule_id, ()),
            )
        )

    group = ("secret", "secrets", "Secrets", "L", "Credential")
    add("SECRET-001", "CRITICAL", "HIGH", "Provider credential in source", lambda ln: ln.has_cs(V.SECRET_PREFIXED))
    add("SECRET-002", "HIGH", "HIGH", "URL with embedded password", lambda ln: ln.has_cs(URL_LOGIN))
    add(
        "SECRET-003",
        "HIGH",
        "MEDIUM",
        "Quoted value assigned to a secret name",
        lambda ln: ln.has(SECRET_ASSIGNMENT) & ~ln.has_cs(V.SECRET_PREFIXED),
    )
    add("SECRET-004", "CRITICAL", "HIGH", "Private key block", lambda ln: ln.has_cs(V.SECRET_PEM))
    add("SECRET-005", "MEDIUM", "MEDIUM", "JSON web token literal", lambda ln: ln.has_cs(V.SECRET_JWT))

    group = ("config", "config", "Configuration", "L", None)
    add("CONFIG-001", "CRITICAL", "HIGH", "Production environment file in the repository",
        lambda ln: ln.flag("env_file") & ln.flag("prod_path"), "file")
    add("CONFIG-001", "HIGH", "HIGH", "Environment file in the repository",
        lambda ln: ln.flag("env_file") & ~ln.flag("prod_path"), "file")
    add("CONFIG-002", "HIGH", "HIGH", "Loopback address in production configuration",
        lambda ln: ln.flag("prod_path") & ~ln.is_comment & ln.has(V.LOOPBACK))
    add("CONFIG-003", "HIGH", "MEDIUM", "Debug mode on in production configuration",
        lambda ln: ln.flag("prod_path") & _debug_on(ln))
    add("CONFIG-003", "MEDIUM", "MEDIUM", "Debug mode on",
        lambda ln: ~ln.flag("prod_path") & _debug_on(ln))
    add("CONFIG-004", "HIGH", "HIGH", "Secret name in a client-exposed variable",
        lambda ln: ln.has(V.CLIENT_ENV_SECRET) & ~ln.has(V.CLIENT_ENV_PUBLIC))
    add("CONFIG-005", "LOW", "MEDIUM", "Documented variables missing from the active environment", scope="repo")
    group = ("config", "config", "Configuration", "L", "Cookie flags")
    add("CONFIG-006", "MEDIUM", "HIGH", "Insecure cookie flag", _cookie_flags)
    group = ("config", "config", "Configuration", "L", "Documentation")
    add("CONFIG-007", "INFO", "MEDIUM", "Variables used in code but not documented", scope="repo")

    group = ("pkg", "dependencies", "Dependencies", "L", None)
    add("PKG-001", "MEDIUM", "HIGH", "Package manifest without lockfile", scope="repo")
    add("PKG-002", "HIGH", "HIGH", "Deny-listed dependency", scope="repo")
    group = ("pkg", "dependencies", "Dependencies", "L", "Supply chain")
    add("PKG-011", "LOW", "HIGH", "Wildcard dependency version", scope="repo")
    add("PKG-012", "LOW", "HIGH", "Dependency from a path or URL", scope="repo")

    group = ("api", "api", "API", "L", None)
    add("API-001", "HIGH", "MEDIUM", "Parameterised route without resource check", scope="special")
    add("API-002", "HIGH", "HIGH", "File operation on a request parameter", _api(V.FILE_FROM_REQUEST))
    add("API-003", "MEDIUM", "HIGH", "Redirect target from the request", _api(V.REDIRECT_FROM_REQUEST))
    add("API-004", "MEDIUM", "HIGH", "Wildcard CORS origin", _api_cors)
    add("API-005", "HIGH", "MEDIUM", "Credential field in a response", _api(V.CREDENTIAL_RESPONSE))

    group = ("auth", "auth", "Authorization", "L", None)
    add("AUTH-001", "HIGH", "HIGH", "Authorization decided in client code",
        lambda ln: ln.flag("is_code") & ln.flag("client_component")
        & (ln.trim_has(V.CLIENT_ROLE_IF) | ln.trim_has(V.CLIENT_ROLE_TERNARY)), "first")
    add("AUTH-002", "HIGH", "MEDIUM", "Admin endpoint without server-side check",
        lambda ln: ln.flag("is_code") & ln.flag("auth_api_path") & ln.flag("admin_path")
        & ~ln.flag("admin_guarded"), "file")
    group = ("auth", "auth", "Authentication", "L", None)
    add("AUTH-003", "CRITICAL", "HIGH", "Token verification accepts the none algorithm",
        lambda ln: ln.flag("is_code") & ln.trim_has(V.JWT_NONE))
    add("AUTH-003", "HIGH", "MEDIUM", "Token decoded but never verified",
        lambda ln: ln.flag("is_code") & ln.trim_has(V.JWT_DECODE) & ~ln.flag("has_jwt_verify"))

    group = ("code", "unsafe-code", "Security", "L", None)
    add("CODE-001", "HIGH", "HIGH", "eval call", _js_code(V.JS_EVAL))
    add("CODE-002", "HIGH", "HIGH", "Function constructor", _js_code(V.JS_NEW_FUNCTION))
    add("CODE-003", "CRITICAL", "HIGH", "Shell command built from strings", _js_code(V.JS_DYNAMIC_EXEC))
    add("CODE-004", "CRITICAL", "HIGH", "SQL text built from strings", _js_code(V.JS_SQL_CONCAT))
    add("CODE-005", "MEDIUM", "HIGH", "Raw HTML sink", _js_code(V.JS_REACT_HTML, V.JS_INNER_HTML))
    add("CODE-006", "HIGH", "HIGH", "eval or exec call in Python", _py_code(V.PY_EVAL))
    add("CODE-007", "CRITICAL", "HIGH", "Shell execution in Python", _py_code(V.PY_SHELL))
    add("CODE-008", "CRITICAL", "HIGH", "Formatted SQL in Python", _py_code(V.PY_SQL_FORMAT))
    add("CODE-009", "HIGH", "HIGH", "Unsafe deserialization in Python", _py_code(V.PY_DESERIALIZE))

    group = ("log", "logging", "Privacy", "L", None)
    add("LOG-003", "HIGH", "HIGH", "Whole environment logged", lambda ln: _logged(ln) & _env_logged(ln))
    add("LOG-001", "HIGH", "HIGH", "Credential logged", _credential_logged)
    add("LOG-002", "MEDIUM", "HIGH", "Stack trace in a response",
        lambda ln: _logged(ln) & ln.trim_has(V.STACK_RESPONSE) & ~_env_logged(ln))

    group = ("sql", "sql-injection", "Database", "C", None)
    add("SQL-001", "HIGH", "HIGH", "SQL built from user input", _sql)
    group = ("cmd", "command-injection", "Security", "C", None)
    add("CMD-001", "CRITICAL", "HIGH", "Command built from user input", lambda ln: _exec(ln) & ln.user_input)
    add("CMD-002", "HIGH", "MEDIUM", "Dynamic process command",
        lambda ln: _exec(ln) & ~ln.user_input & ~_static_command(ln) & ln.joined)
    group = ("path", "path-traversal", "Security", "C", None)
    add("PATH-001", "HIGH", "HIGH", "File path from user input",
        lambda ln: ln.flag("is_code") & ln.user_input & ln.has(V.FS_OPERATION))
    group = ("ssrf", "ssrf", "Security", "C", None)
    add("SSRF-001", "HIGH", "HIGH", "Outgoing request target from user input",
        lambda ln: ln.flag("is_code") & ln.user_input & ln.has(V.HTTP_CLIENT) & ~ln.trim_has(V.STATIC_URL))
    group = ("xss", "xss", "Security", "C", None)
    add("XSS-001", "HIGH", "HIGH", "Unsanitized HTML sink fed by input", lambda ln: _xss(ln) & ln.has(V.HTML_INPUT))
    add("XSS-001", "MEDIUM", "MEDIUM", "Unsanitized HTML sink", lambda ln: _xss(ln) & ~ln.has(V.HTML_INPUT))
    group = ("authz", "authorization", "Authorization", "C", None)
    add("AUTHZ-001", "HIGH", "HIGH", "Role taken from the request",
        lambda ln: ln.flag("is_code") & ln.has(V.CLIENT_ROLE))
    add("AUTHZ-002", "HIGH", "MEDIUM", "Object route without owner check", _bola)
    group = ("auth", "auth-security", "Authentication", "C", None)
    add("AUTH-004", "HIGH", "HIGH", "Password taken without hashing",
        lambda ln: ln.flag("is_code") & ln.flag("unhashed_password") & ln.has(V.PASSWORD_FROM_REQUEST))
    add("AUTH-005", "MEDIUM", "HIGH", "Token signed without expiry", _jwt_no_expiry)
    add("AUTH-006", "MEDIUM", "HIGH", "Cookie readable by scripts", _cookie)
    group = ("cors", "cors", "Configuration", "C", None)
    add("CORS-001", "HIGH", "HIGH", "Wildcard origin with credentials", _cors_wildcard)
    add("CORS-002", "HIGH", "HIGH", "Request origin reflected", _cors_reflected)
    group = ("headers", "headers", "Configuration", "C", None)
    add("HDR-001", "LOW", "MEDIUM", "No security headers configured", scope="repo")
    group = ("err", "error-disclosure", "Reliability", "C", None)
    add("ERR-001", "MEDIUM", "HIGH", "Error details in a response",
        lambda ln: ln.flag("is_code") & ln.has(V.ERROR_RESPONSE))
    group = ("cfg", "misconfiguration", "Configuration", "C", None)
    add("CFG-001", "HIGH", "HIGH", "Root environment file", scope="repo")
    add("CFG-002", "MEDIUM", "HIGH", "Debug or development mode",
        lambda ln: ln.flag("is_misconfig") & ln.has(V.DEBUG_SETTING), "first")
    add("CFG-003", "LOW", "MEDIUM", "Localhost endpoint",
        lambda ln: ln.flag("is_misconfig") & ln.has(V.LOCAL_ENDPOINT), "first")

    group = ("rel", "reliability", "Reliability", "F", "Input and output")
    add("REL-001", "MEDIUM", "HIGH", "Blocking file call in a server module",
        lambda ln: _reliable(ln) & ln.has_cs(V.SYNC_IO) & ln.flag("has_server_marker"))
    group = ("rel", "reliability", "Reliability", "F", "Error handling")
    add("REL-003", "LOW", "HIGH", "Swallowed exception in test or sample",
        lambda ln: _swallowed(ln) & ln.flag("rel_test_doc"))
    add("REL-003", "MEDIUM", "HIGH", "Swallowed exception", lambda ln: _swallowed(ln) & ~ln.flag("rel_test_doc"))
    group = ("rel", "reliability", "Reliability", "F", "Resilience")
    add("REL-002", "MEDIUM", "MEDIUM", "Network call without timeout", _no_timeout)
    group = ("rel", "reliability", "Reliability", "F", "Async safety")
    add("REL-004", "LOW", "MEDIUM", "Promise without rejection handler", _unhandled_promise)
    group = ("rel", "reliability", "Reliability", "F", "Memory")
    add("REL-006", "LOW", "LOW", "Unbounded in-memory container",
        lambda ln: _reliable(ln) & ln.has_cs(V.UNBOUNDED_STATE))

    group = ("obs", "observability", "Observability", "R", "Health checks")
    add("OBS-001", "INFO", "HIGH", "No health endpoint", scope="repo", tag="health")
    group = ("obs", "observability", "Observability", "R", "Lifecycle")
    add("OBS-002", "LOW", "MEDIUM", "No graceful shutdown", scope="repo", tag="shutdown")
    group = ("obs", "observability", "Observability", "R", "Telemetry")
    add("OBS-003", "INFO", "LOW", "No structured logging", scope="repo", tag="logging")

    group = ("deploy", "deployment", "Deployment", "F", "Container")
    add("DEP-001", "HIGH", "HIGH", "Container runs as root", _docker(V.DOCKER_ROOT))
    add("DEP-001", "MEDIUM", "MEDIUM", "Container without USER", scope="special")
    add("DEP-002", "LOW", "HIGH", "Floating base image tag", _docker(V.DOCKER_LATEST))
    add("DEP-003", "CRITICAL", "HIGH", "Environment file copied into an image", _docker(V.DOCKER_COPY_ENV))
    add("DEP-004", "INFO", "HIGH", "Container without health check", scope="special")
    add("DEP-005", "HIGH", "HIGH", "Privileged or host-network service",
        lambda ln: ln.flag("is_compose") & (ln.has(V.COMPOSE_PRIVILEGED) | ln.has(V.COMPOSE_HOST_NETWORK)))
    group = ("deploy", "deployment", "Deployment", "F", "Pipeline")
    add("DEP-006", "HIGH", "HIGH", "Secret echoed in a pipeline", _ci(V.CI_SECRET_ECHO))
    add("DEP-007", "LOW", "HIGH", "Action pinned to a movable tag", _ci(V.CI_MUTABLE_ACTION, True, False))

    group = ("tst", "testing", "Testing", "R", "Coverage")
    add("TST-001", "LOW", "HIGH", "No tests", scope="repo", tag="tests")
    group = ("tst", "testing", "Testing", "R", "Pipeline")
    add("TST-002", "INFO", "MEDIUM", "Tests never run in the pipeline", scope="repo", tag="citest")

    group = ("dat", "data-exposure", "Data Safety", "F", "Data exposure")
    add("DAT-001", "HIGH", "HIGH", "Sensitive field logged",
        lambda ln: ln.flag("is_code") & ~ln.flag("data_test") & ln.has(V.SENSITIVE_LOGGED))
    add("DAT-002", "HIGH", "HIGH", "Secret in a query string",
        lambda ln: ln.flag("is_code")
        & (ln.has(V.SECRET_IN_GET_ROUTE) | (ln.has(V.SECRET_IN_QUERY) & ~ln.flag("has_body"))))
    add("DAT-003", "CRITICAL", "HIGH", "Hash or key returned",
        lambda ln: ln.flag("is_code") & ~ln.flag("data_test") & ln.has(V.HASH_IN_RESPONSE))

    group = ("corr", "correlation", "Security", "C", None)
    add("CORR", "CRITICAL", "HIGH", "Unprotected route reaches the database", scope="repo")
    return out


RULES: list[Rule] = _rules()
FAMILIES = tuple(dict.fromkeys(r.family for r in RULES))


def ordinals(rule_id: str) -> list[int]:
    """Positions in :data:`RULES` of the ways ``rule_id`` can fire."""
    return [i for i, r in enumerate(RULES) if r.rule_id == rule_id]


def family_rules(*families: str) -> list[int]:
    return [i for i, r in enumerate(RULES) if r.family in families]


def line_words(rules: Iterable[Rule]) -> tuple[str, ...] | None:
    """Words of which every line the rules can match holds one; None if no such list is known.

    Infrastructure files are read in full, so their rules need no words.
    """
    found: dict[str, None] = {}
    for rule in rules:
        if rule.scope not in ("line", "first") or rule.family == "deploy":
            continue
        if not rule.words:
            return None
        found.update(dict.fromkeys(rule.words))
    return tuple(w for w in found if not any(o != w and o in w for o in found))


def holds_any(lower_text: Column, words: Sequence[str]) -> Column:
    if len(words) == 1:
        return lower_text.contains(words[0])
    return F.exists(constant_array(words), lambda w: lower_text.contains(w))
