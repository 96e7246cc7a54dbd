"""SQL twins: shared table expressions, written for DuckDB by hand.

Only plain data is shared with the Spark side: planted snippets, pattern texts
and the rule catalog. The logic around them is written here a second time.
"""

from __future__ import annotations

from auditloom.functions.text import KNOWN_PREFIXES, SECRET_ASSIGNMENT, URL_LOGIN
from auditloom.operators import fixed_values as V
from auditloom.operators.rules import RULES, ordinals
from auditloom.sources import plants as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def m(col: str, pattern: str) -> str:
    """Case-insensitive search."""
    return f"regexp_matches({col}, {q(pattern)}, 'i')"


def mc(col: str, pattern: str) -> str:
    """Case-sensitive search."""
    return f"regexp_matches({col}, {q(pattern)})"


def has_any(col: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def ends_any(col: str, *words: str) -> str:
    return "(" + " OR ".join(f"ends_with({col}, {q(w)})" for w in words) + ")"


def one_of(col: str, *words: str) -> str:
    return f"{col} IN ({', '.join(q(w) for w in words)})"


def trim(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def pick(options, index: str) -> str:
    return f"{sql_list(options)}[({index}) % {len(options)} + 1]"


def _path(*options: str) -> str:
    return f"replace({pick(options, 'block')}, '%N', doc_id::VARCHAR)"


def _hash_lines(mark: str) -> str:
    return f"({q(mark)} || replace(text, chr(10), chr(10) || {q(mark)}))"


def _conf(options) -> str:
    return f"{pick(options, 'block')} || chr(10) || {_hash_lines('# ')}"


CORPUS = f"""
docs AS (SELECT doc_id, text, doc_id // 40 AS block, doc_id % 40 AS slot FROM documents),
named AS (
  SELECT *, 'repo-' || block AS repo_id,
    CASE slot
      WHEN 0 THEN {_path("package.json", "package.json", "package.json", "src/misc/unit_%N.js")}
      WHEN 1 THEN {_path("package-lock.json", "yarn.lock", "src/notes/unit_%N.ts")}
      WHEN 2 THEN {_path("requirements.txt", "pyproject.toml")}
      WHEN 3 THEN {_path(".env.example", ".env.example", "config/settings.py")}
      WHEN 4 THEN {_path(".env", ".env.production", ".env.local")}
      WHEN 5 THEN 'Dockerfile'
      WHEN 6 THEN 'docker-compose.yml'
      WHEN 7 THEN {_path(".github/workflows/ci.yml", ".gitlab-ci.yml")}
      WHEN 8 THEN '.gitignore'
      WHEN 9 THEN '.auditignore'
      WHEN 10 THEN {_path(".auditrc", "audit.config.json", ".auditrc.json", "src/lib/unit_%N.js")}
      WHEN 11 THEN {_path("app/(shop)/items/[id]/route.ts", "app/api/orders/route.js")}
      WHEN 12 THEN {_path("pages/api/users/unit_%N.ts", "pages/api/index.js")}
      WHEN 13 THEN 'next.config.js'
      WHEN 14 THEN {_path("config/prod.json", "config/app.json")}
      WHEN 15 THEN {_path("node_modules/pkg/unit_%N.js")}
      WHEN 16 THEN {_path("dist/unit_%N.js", "server/old/unit_%N.js")}
      WHEN 17 THEN {_path("tests/app.test.js", "src/util/unit_%N.js", "src/util/unit_%N.js")}
      WHEN 18 THEN {_path("db/schema_%N.sql")}
      WHEN 19 THEN {_path("prisma/unit_%N.js", "migrations/unit_%N.js")}
      ELSE {pick(P.CODE_DIRS, "slot + block")} || 'unit_' || doc_id || {pick(P.CODE_EXTS, "doc_id")}
    END AS path
  FROM docs),
filled AS (
  SELECT repo_id, path,
    CASE
      WHEN path = 'package.json' THEN '{{"name":"pkg-' || block || '","description":"'
        || regexp_replace(text, '[^A-Za-z ]', ' ', 'g') || '",' || {pick(P.PACKAGE_PLANTS, "block")} || '}}'
      WHEN path = 'package-lock.json' THEN {pick(P.LOCK_PLANTS, "block // 3")}
      WHEN path = 'requirements.txt' THEN {_conf(P.REQUIREMENT_PLANTS)}
      WHEN path = 'pyproject.toml' THEN 'fastapi' || chr(10) || {_hash_lines("# ")}
      WHEN path = 'yarn.lock' THEN {_hash_lines("# ")}
      WHEN path = '.env.example' THEN {_conf(P.ENV_EXAMPLE_PLANTS)}
      WHEN starts_with(path, '.env') THEN {_conf(P.ENV_PLANTS)}
      WHEN path = 'Dockerfile' THEN {_conf(P.DOCKER_PLANTS)}
      WHEN path = 'docker-compose.yml' THEN {_conf(P.COMPOSE_PLANTS)}
      WHEN contains(path, 'ci.yml') THEN {_conf(P.CI_PLANTS)}
      WHEN path = '.gitignore' THEN {_conf(P.GITIGNORE_PLANTS)}
      WHEN path = '.auditignore' THEN {_conf(P.IGNORE_LIST_PLANTS)}
      WHEN path IN ('.auditrc', 'audit.config.json', '.auditrc.json') THEN {pick(P.POLICY_PLANTS, "block")}
      WHEN starts_with(path, 'app/(') OR starts_with(path, 'app/api/')
        THEN text || chr(10) || {pick(P.NEXT_APP_PLANTS, "block")}
      WHEN starts_with(path, 'pages/api/') THEN text || chr(10) || {pick(P.NEXT_PAGES_PLANTS, "block")}
      WHEN path = 'next.config.js' THEN {q(P.NEXT_CONFIG_PLANT)} || chr(10) || text
      WHEN path IN ('config/prod.json', 'config/app.json') THEN {q(P.PROD_JSON_PLANT)} || chr(10) || text
      WHEN ends_with(path, '.sql') THEN {q(P.SQL_FILE_PLANT)} || chr(10) || {_hash_lines("-- ")}
      WHEN ends_with(path, '.py')
        THEN {_hash_lines("# ")} || chr(10) || {pick(P.PY_PLANTS, "doc_id + block")} || chr(10)
      ELSE text || chr(10) || {pick(P.JS_PLANTS, "slot + block * 7")} || chr(10)
    END AS content
  FROM named),
source AS (
  SELECT repo_id, path, strlen(content)::BIGINT AS length, content,
    regexp_extract(path, '[^/]*$') AS base,
    lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1)) AS ext
  FROM filled),
kept AS (
  SELECT * FROM source
  WHERE NOT list_has_any(string_split(path, '/'),
    ['node_modules', '.git', 'dist', 'build', '.next', '.cache', 'coverage', '.auditloom'])),
files AS (SELECT * FROM kept WHERE length <= 1048576)
"""

CODE = one_of("ext", ".js", ".ts", ".jsx", ".tsx", ".py")
JS = one_of("ext", ".js", ".ts", ".jsx", ".tsx")

LINES = rf"""
split AS (SELECT repo_id, path, ext, base, content, string_split_regex(content, '\r?\n') AS ls FROM files),
raw_lines AS (SELECT *, unnest(ls) AS text, generate_subscripts(ls, 1)::INT AS line FROM split),
ln AS MATERIALIZED (
  SELECT *, {trim("text")} AS t,
    (starts_with({trim("text")}, '//') OR starts_with({trim("text")}, '#')) AS comment,
    {m("text", V.USER_INPUT)} AS ui,
    {has_any("text", "+", "`", "%", ".format(")} AS dyn
  FROM raw_lines)
"""

EXEC = f"({CODE} AND {m('text', V.PROCESS_EXEC)})"
STATIC_CMD = rf"({mc('t', V.STATIC_COMMAND)} OR NOT {has_any('text', '+', '$', '`')})"
XSS = f"({JS} AND {m('text', V.HTML_SINK)} AND NOT ({m('text', V.HTML_CLEANER)} OR {m('t', V.STATIC_HTML)}))"
WILDCARD = f"({m('text', V.CORS_WILDCARD)} AND contains(lower(content), 'credentials'))"
NOT_SPEC = f"({CODE} AND NOT comment AND NOT {has_any('path', 'test', 'spec')})"
ENV_DUMP = f"({m('t', V.ENV_LOGGED_JS)} OR {m('t', V.ENV_LOGGED_PY)})"
UNSAFE_JS = f"({one_of('ext', '.js', '.ts', '.jsx', '.tsx', '.mjs')} AND NOT ends_with(path, '.py') AND NOT comment)"
UNSAFE_PY = "(ends_with(path, '.py') AND NOT comment)"
PROD = "contains(path, 'prod')"
DEBUG = f"""(({has_any('path', 'config', 'settings', '.env.', 'prod')} OR ends_with(path, '.env') OR ends_with(path, '.py'))
  AND ({mc('t', V.DEBUG_FLAG)} OR {mc('t', V.DEBUG_JSON)}) AND NOT comment AND NOT contains(path, 'test'))"""
REL_EXT = one_of("ext", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py")
REL_SKIP = has_any("path", "test", "fixture", "example", "doc")
SWALLOWED = f"""({REL_EXT} AND ({mc('text', V.EMPTY_CATCH)} OR (contains(text, 'catch') AND ends_with(text, '{{}}'))
  OR {mc('text', V.EXCEPT_PASS)} OR {mc('text', V.EXCEPT_TYPE_PASS)}))"""
DATA_SKIP = has_any("path", "test", "fixture", "example")
DOCKER = "contains(lower(base), 'dockerfile')"
COMPOSE = "(contains(lower(base), 'docker-compose') OR contains(lower(base), 'compose.yaml'))"
CI = "(contains(path, '.github/workflows') OR contains(path, '.gitlab-ci'))"


def near(count: int, sep: str) -> str:
    return f"array_to_string(ls[line:line + {count - 1}], {sep})"


# (rule id, which of its entries, condition on a line)
LINE_RULES: list[tuple[str, int, str]] = [
    ("SECRET-001", 0, mc("text", V.SECRET_PREFIXED)),
    ("SECRET-002", 0, mc("text", URL_LOGIN)),
    ("SECRET-003", 0, f"{m('text', SECRET_ASSIGNMENT)} AND NOT {mc('text', V.SECRET_PREFIXED)}"),
    ("SECRET-004", 0, mc("text", V.SECRET_PEM)),
    ("SECRET-005", 0, mc("text", V.SECRET_JWT)),
    ("CONFIG-002", 0, f"{PROD} AND {has_any('lower(text)', 'localhost', '127.0.0.1')} AND NOT comment"),
    ("CONFIG-003", 0, f"{DEBUG} AND {PROD}"),
    ("CONFIG-003", 1, f"{DEBUG} AND NOT {PROD}"),
    ("CONFIG-004", 0, f"{m('text', V.CLIENT_ENV_SECRET)} AND NOT {has_any('upper(text)', 'PUBLISHABLE', 'ANON', 'PUBLIC_KEY')}"),
    ("CONFIG-006", 0, " OR ".join(m("t", p) for p in V.COOKIE_FLAGS)),
    ("API-002", 0, f"{CODE} AND NOT comment AND {m('text', V.FILE_FROM_REQUEST)}"),
    ("API-003", 0, f"{CODE} AND NOT comment AND {m('text', V.REDIRECT_FROM_REQUEST)}"),
    ("API-004", 0, f"""{CODE} AND NOT comment AND ({m('text', V.CORS_CALL_WILDCARD)}
        OR {m('text', V.CORS_HEADER_WILDCARD)} OR {m('text', V.CORS_MIDDLEWARE_WILDCARD)})"""),
    ("API-005", 0, f"{CODE} AND NOT comment AND {m('text', V.CREDENTIAL_RESPONSE)}"),
    ("AUTH-003", 0, f"{CODE} AND {m('t', V.JWT_NONE)}"),
    ("AUTH-003", 1, f"{CODE} AND {m('t', V.JWT_DECODE)} AND NOT contains(lower(content), 'jwt.verify')"),
    ("CODE-001", 0, f"{UNSAFE_JS} AND {m('t', V.JS_EVAL)}"),
    ("CODE-002", 0, f"{UNSAFE_JS} AND {m('t', V.JS_NEW_FUNCTION)}"),
    ("CODE-003", 0, f"{UNSAFE_JS} AND {m('t', V.JS_DYNAMIC_EXEC)}"),
    ("CODE-004", 0, f"{UNSAFE_JS} AND {m('t', V.JS_SQL_CONCAT)}"),
    ("CODE-005", 0, f"{UNSAFE_JS} AND ({m('t', V.JS_REACT_HTML)} OR {m('t', V.JS_INNER_HTML)})"),
    ("CODE-006", 0, f"{UNSAFE_PY} AND {m('t', V.PY_EVAL)}"),
    ("CODE-007", 0, f"{UNSAFE_PY} AND {m('t', V.PY_SHELL)}"),
    ("CODE-008", 0, f"{UNSAFE_PY} AND {m('t', V.PY_SQL_FORMAT)}"),
    ("CODE-009", 0, f"{UNSAFE_PY} AND {m('t', V.PY_DESERIALIZE)}"),
    ("LOG-003", 0, f"{NOT_SPEC} AND {ENV_DUMP}"),
    ("LOG-001", 0, f"""{NOT_SPEC} AND NOT {ENV_DUMP} AND {m('t', V.CREDENTIAL_LOGGED)}
        AND (NOT {m('t', V.STATUS_MESSAGE)} OR {m('t', V.LOGGED_ARGUMENT)})"""),
    ("LOG-002", 0, f"{NOT_SPEC} AND NOT {ENV_DUMP} AND {m('t', V.STACK_RESPONSE)}"),
    ("SQL-001", 0, f"""{CODE} AND {m('text', V.SQL_CONTEXT)} AND ui AND (dyn OR contains(text, 'f"'))
        AND NOT ({mc('text', V.SQL_PLACEHOLDER)} AND ({mc('text', V.SQL_LIST)} OR {m('text', V.SQL_BIND_WORD)}))"""),
    ("CMD-001", 0, f"{EXEC} AND ui"),
    ("CMD-002", 0, f"{EXEC} AND NOT ui AND dyn AND NOT {STATIC_CMD}"),
    ("PATH-001", 0, f"{CODE} AND ui AND {m('text', V.FS_OPERATION)}"),
    ("SSRF-001", 0, f"{CODE} AND ui AND {m('text', V.HTTP_CLIENT)} AND NOT {m('t', V.STATIC_URL)}"),
    ("XSS-001", 0, f"{XSS} AND {m('text', V.HTML_INPUT)}"),
    ("XSS-001", 1, f"{XSS} AND NOT {m('text', V.HTML_INPUT)}"),
    ("AUTHZ-001", 0, f"{CODE} AND {m('text', V.CLIENT_ROLE)}"),
    ("AUTHZ-002", 0, f"""{CODE} AND {m('text', V.SENSITIVE_ROUTE)} AND {m(near(30, 'chr(10)'), V.NEARBY_AUTH)}
        AND NOT {m(near(30, 'chr(10)'), V.OWNER_CHECK)}"""),
    ("AUTH-004", 0, f"{CODE} AND {m('text', V.PASSWORD_FROM_REQUEST)} AND NOT {m('content', V.PASSWORD_HASHING)}"),
    ("AUTH-005", 0, f"{CODE} AND {m('text', V.JWT_SIGN)} AND NOT contains(lower({near(10, q(' '))}), 'exp')"),
    ("AUTH-006", 0, f"""{CODE} AND {m('text', V.COOKIE_SET)}
        AND ({m('text', V.HTTP_ONLY_OFF)} OR NOT contains(content, 'httpOnly'))"""),
    ("CORS-001", 0, f"({CODE} OR ext = '.json') AND {WILDCARD}"),
    ("CORS-002", 0, f"""({CODE} OR ext = '.json') AND NOT {WILDCARD}
        AND ({m('text', V.CORS_REFLECTED_HEADER)} OR {m('text', V.CORS_REFLECTED_OPTION)})"""),
    ("ERR-001", 0, f"{CODE} AND {m('text', V.ERROR_RESPONSE)}"),
    ("REL-001", 0, f"""{REL_EXT} AND NOT {REL_SKIP} AND {mc('text', V.SYNC_IO)}
        AND {has_any('content', 'express', 'app.get', 'app.post', 'router.', 'req, res', 'NextResponse', 'NextApiRequest')}"""),
    ("REL-003", 0, f"{SWALLOWED} AND {REL_SKIP}"),
    ("REL-003", 1, f"{SWALLOWED} AND NOT {REL_SKIP}"),
    ("REL-002", 0, f"""{REL_EXT} AND NOT {REL_SKIP} AND ({mc('text', V.HTTP_CALL_JS)} OR {mc('text', V.HTTP_CALL_PY)})
        AND NOT {has_any('text', 'timeout', 'signal')}"""),
    ("REL-004", 0, f"""{REL_EXT} AND NOT {REL_SKIP} AND contains(text, '.then(') AND NOT contains(text, '.catch(')
        AND NOT contains(substring(content, strpos(content, text)), '.catch(')"""),
    ("REL-006", 0, f"{REL_EXT} AND NOT {REL_SKIP} AND {mc('text', V.UNBOUNDED_STATE)}"),
    ("DEP-001", 0, f"{DOCKER} AND {m('t', V.DOCKER_ROOT)}"),
    ("DEP-002", 0, f"{DOCKER} AND {m('t', V.DOCKER_LATEST)}"),
    ("DEP-003", 0, f"{DOCKER} AND {m('t', V.DOCKER_COPY_ENV)}"),
    ("DEP-005", 0, f"{COMPOSE} AND ({m('text', V.COMPOSE_PRIVILEGED)} OR {m('text', V.COMPOSE_HOST_NETWORK)})"),
    ("DEP-006", 0, f"{CI} AND {m('text', V.CI_SECRET_ECHO)}"),
    ("DEP-007", 0, f"{CI} AND {mc('t', V.CI_MUTABLE_ACTION)}"),
    ("DAT-001", 0, f"{CODE} AND NOT {DATA_SKIP} AND {m('text', V.SENSITIVE_LOGGED)}"),
    ("DAT-002", 0, f"""{CODE} AND ({m('text', V.SECRET_IN_GET_ROUTE)}
        OR ({m('text', V.SECRET_IN_QUERY)} AND NOT contains(content, 'req.body')))"""),
    ("DAT-003", 0, f"{CODE} AND NOT {DATA_SKIP} AND {m('text', V.HASH_IN_RESPONSE)}"),
]

# first matching line of each file
FIRST_RULES: list[tuple[str, int, str]] = [
    ("AUTH-001", 0, f"""{CODE} AND ({has_any('content', "'use client'", '"use client"')} OR contains(path, 'components/')
        OR {ends_any('path', '.tsx', '.jsx')}) AND ({m('t', V.CLIENT_ROLE_IF)} OR {m('t', V.CLIENT_ROLE_TERNARY)})"""),
    ("CFG-002", 0, f"({one_of('ext', *V.MISCONFIG_EXT)} OR {one_of('base', *V.MISCONFIG_EXT)}) AND {m('text', V.DEBUG_SETTING)}"),
    ("CFG-003", 0, f"({one_of('ext', *V.MISCONFIG_EXT)} OR {one_of('base', *V.MISCONFIG_EXT)}) AND {m('text', V.LOCAL_ENDPOINT)}"),
]

CLEAN_CODE = r"regexp_replace(content, '//.*|/\*[\s\S]*?\*/', '', 'g')"
ENV_FILE = f"(starts_with(base, '.env') AND NOT {one_of('path', *V.ENV_TEMPLATES)})"

# (rule id, entry, condition on a file, line, text)
FILE_RULES: list[tuple[str, int, str, str, str]] = [
    ("CONFIG-001", 0, f"{ENV_FILE} AND {PROD}", "1", "path"),
    ("CONFIG-001", 1, f"{ENV_FILE} AND NOT {PROD}", "1", "path"),
    ("AUTH-002", 0, f"""{CODE} AND ({has_any('path', 'api/', 'routes/')} OR {ends_any('path', 'route.ts', 'route.js')})
        AND {has_any('path', 'admin', 'manage')} AND NOT {m('content', V.ADMIN_GUARD)}""", "1", "path"),
    ("API-001", 0, f"""{CODE} AND ({has_any('path', 'api/', 'routes/', 'controllers/', 'views.py')}
        OR {ends_any('path', 'route.ts', 'route.js')})
        AND ({has_any('path', '[', ':id')} OR {mc(CLEAN_CODE, V.ID_PARAMETER)})
        AND {m(CLEAN_CODE, V.RESOURCE_ACCESS)} AND NOT {m(CLEAN_CODE, V.RESOURCE_GUARD)}""",
        f"coalesce((SELECT min(line) FROM ln l WHERE l.repo_id = f.repo_id AND l.path = f.path AND {mc('l.text', V.PARAMETER_LINE)}), 1)",
        None),
    ("DEP-001", 1, f"{DOCKER} AND NOT EXISTS (SELECT 1 FROM ln l WHERE l.repo_id = f.repo_id AND l.path = f.path AND {mc('l.t', V.DOCKER_USER)})",
        "1", "'No USER directive.'"),
    ("DEP-004", 0, f"{DOCKER} AND NOT EXISTS (SELECT 1 FROM ln l WHERE l.repo_id = f.repo_id AND l.path = f.path AND {mc('l.t', V.DOCKER_HEALTH)})",
        "1", "'No HEALTHCHECK directive.'"),
]


def _ord(rule_id: str, entry: int) -> int:
    return ordinals(rule_id)[entry]


def hits_sql(chosen: set[int] | None = None) -> str:
    """CTEs up to ``hits``: (repo_id, path, line, text, ord)."""
    wanted = set(range(len(RULES))) if chosen is None else chosen
    lines = [f"CASE WHEN {c} THEN {_ord(r, e)} END" for r, e, c in LINE_RULES if _ord(r, e) in wanted]
    parts = []
    if lines:
        parts.append(
            "SELECT repo_id, path, line, text, unnest(list_filter(["
            + ",\n".join(lines)
            + "], lambda x: x IS NOT NULL)) AS ord FROM ln"
        )
    for r, e, c in FIRST_RULES:
        if _ord(r, e) in wanted:
            parts.append(
                f"SELECT repo_id, path, min(line) AS line, arg_min(text, line) AS text, {_ord(r, e)} AS ord"
                f" FROM ln WHERE {c} GROUP BY repo_id, path"
            )
    for r, e, c, line, text in FILE_RULES:
        if _ord(r, e) not in wanted:
            continue
        if text is None:
            parts.append(
                f"SELECT h.repo_id, h.path, h.line, CASE WHEN l.t = '' THEN h.path ELSE l.text END AS text, {_ord(r, e)} AS ord"
                f" FROM (SELECT repo_id, path, {line} AS line FROM files f WHERE {c}) h"
                " JOIN ln l ON l.repo_id = h.repo_id AND l.path = h.path AND l.line = h.line"
            )
        else:
            parts.append(f"SELECT repo_id, path, {line} AS line, {text} AS text, {_ord(r, e)} AS ord FROM files f WHERE {c}")
    body = "\nUNION ALL\n".join(parts) or "SELECT '' AS repo_id, '' AS path, 1 AS line, '' AS text, 0 AS ord WHERE false"
    return f"{CORPUS}, {LINES}, rule_hits AS ({body})"


def _catalog() -> str:
    rows = ", ".join(
        "("
        + ", ".join(
            [str(i)]
            + [
                "NULL" if v is None else q(v)
                for v in (r.rule_id, r.title, r.category, r.subcategory, r.analyzer, r.severity, r.confidence, r.key, r.tag)
            ]
        )
        + ")"
        for i, r in enumerate(RULES)
    )
    return (
        f"catalog AS (SELECT * FROM (VALUES {rows}) AS c(ord, rule_id, title, category, subcategory, analyzer,"
        " severity, confidence, key, tag))"
    )


CATALOG = _catalog()
RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def _re_escape(text: str) -> str:
    return text.replace(".", r"\.")


def _mask_prefix(s: str) -> str:
    """Every known-prefix token of six or more characters, prefix by prefix."""
    return (
        f"list_reduce({sql_list(_re_escape(p) for p in KNOWN_PREFIXES)}, lambda s, p: array_to_string(list_transform(list_zip("
        "string_split_regex(s, p || '[A-Za-z0-9_\\-]{6,}'), regexp_extract_all(s, p || '[A-Za-z0-9_\\-]{6,}')), "
        "lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE replace(p, '\\', '') "
        "|| repeat('*', length(z[2]) - length(replace(p, '\\', ''))) END), ''), "
        f"{s})"
    )


def mask_secret_sql(v: str) -> str:
    """Mask one trimmed value."""
    prefix_cases = " ".join(
        f"WHEN starts_with({v}, {q(p)}) THEN {q(p)} || repeat('*', greatest(6, length({v}) - {len(p)}))" for p in KNOWN_PREFIXES
    )
    url = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)([^:]+):(.*)(@[^@]*)$"
    # the login ends at the last @ and must hold a colon after its first character
    return (
        f"CASE WHEN {v} IS NULL OR length({v}) <= 6 THEN '******'"
        f" WHEN regexp_matches({v}, {q(url)}) AND NOT contains(regexp_extract({v}, {q(url)}, 2), '@')"
        f" THEN regexp_replace({v}, {q(url)}, '\\1\\2:********\\4')"
        f" {prefix_cases}"
        f" ELSE left({v}, least(4, length({v}) // 3)) || repeat('*', greatest(6, length({v}) - least(4, length({v}) // 3))) END"
    )


def mask_sql(text: str) -> str:
    """Mask a snippet: URL passwords, prefixed tokens, quoted assignments."""
    rx = "(?i)" + SECRET_ASSIGNMENT
    urls = f"regexp_replace({text}, {q(URL_LOGIN)}, '\\1\\2:********\\4', 'g')"
    known = _mask_prefix(urls)
    lead = f"regexp_extract(z[2], {q(rx)}, 1)"
    value = f"regexp_extract(z[2], {q(rx)}, 2)"
    tail = f"regexp_extract(z[2], {q(rx)}, 3)"
    return (
        f"(SELECT array_to_string(list_transform(list_zip(string_split_regex(k, {q(rx)}), regexp_extract_all(k, {q(rx)})),"
        f" lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {lead} || {mask_secret_sql(value)} || {tail} END), '')"
        f" FROM (SELECT {known} AS k))"
    )


FINDING_LIST = (
    "repo_id, rule_id, title, category, subcategory, analyzer, severity, severity_rank, confidence, file, line,"
    " snippet, fingerprint, ord"
)


def findings_sql(hits: str, name: str = "raw") -> str:
    """CTEs turning ``hits`` (repo_id, path, line, text, ord, fp_text) into findings called ``name``."""
    squeezed = rf"regexp_replace({trim('x')}, '\s+', ' ', 'g')"
    return rf"""
{name}_shown AS (
  SELECT h.*, c.* EXCLUDE (ord), {trim('h.text')} AS shown FROM {hits} h JOIN catalog c USING (ord)),
{name}_masked AS (
  SELECT *, CASE WHEN category = 'Secrets'
      THEN regexp_replace(masked, {q(V.SECRET_JWT)}, 'eyJ******', 'g') ELSE masked END AS snippet
  FROM (SELECT *, {mask_sql('shown')} AS masked FROM {name}_shown)),
{name}_id AS (
  SELECT *, CASE WHEN category = 'Secrets' THEN snippet ELSE coalesce(fp_text, text) END AS x FROM {name}_masked),
{name} AS (
  SELECT repo_id, rule_id, title, category, subcategory, analyzer, severity, {RANK} AS severity_rank, confidence,
    path AS file, line, snippet,
    sha256(rule_id || ':' || CASE key WHEN 'R' THEN repo_id ELSE path END || ':'
      || CASE key WHEN 'R' THEN tag WHEN 'C' THEN category ELSE '' END || ':'
      || CASE WHEN key IN ('L', 'C') THEN {squeezed} ELSE '' END)[1:16] AS fingerprint,
    ord
  FROM {name}_id)"""


def family_sql(chosen: set[int]) -> str:
    return f"""WITH {hits_sql(chosen)}, hits AS (SELECT *, NULL::VARCHAR AS fp_text FROM rule_hits),
{CATALOG}, {findings_sql('hits')}
SELECT repo_id, rule_id, severity, confidence, file, line, snippet, fingerprint FROM raw"""
