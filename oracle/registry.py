"""The SQL twin of every registered query (DuckDB), written by hand."""

from __future__ import annotations

import json

from auditloom.functions.text import ANSI_CODE
from auditloom.operators import fixed_values as V
from auditloom.operators.rules import FAMILIES, RULES, family_rules, ordinals
from oracle.base import (
    CATALOG,
    CODE,
    CORPUS,
    DOCKER,
    FINDING_LIST,
    LINES,
    RANK,
    family_sql,
    findings_sql,
    has_any,
    hits_sql,
    m,
    mask_secret_sql,
    mask_sql,
    mc,
    one_of,
    ends_any,
    q,
    sql_list,
    trim,
)

ORACLES: dict[str, str] = {}
SHORT = "repo_id, rule_id, severity, confidence, file, line, snippet, fingerprint"


def _o(rule_id: str, entry: int = 0) -> int:
    return ordinals(rule_id)[entry]


# --- sources and file predicates ------------------------------------------------------------

ORACLES["corpus"] = f"WITH {CORPUS} SELECT repo_id, path, length, md5(content) AS content_md5 FROM source"
ORACLES["scanned_tree"] = ORACLES["corpus"]
ORACLES["lines"] = rf"""WITH {CORPUS}
SELECT repo_id, path, unnest(string_split_regex(content, '\r?\n')) AS text,
  generate_subscripts(string_split_regex(content, '\r?\n'), 1)::INT AS line FROM files"""
ORACLES["files_by_extension"] = f"""WITH {CORPUS}
SELECT repo_id, path, length FROM source WHERE ext IN ('.js', '.py') OR base = 'Dockerfile'"""
ORACLES["ignored_paths"] = f"WITH {CORPUS} SELECT repo_id, path FROM kept"

POLICIES = f"""
policy_files AS (
  SELECT repo_id, path, content::JSON AS j,
    CASE path WHEN '.auditrc' THEN 1 WHEN 'audit.config.json' THEN 2 ELSE 3 END AS rank
  FROM source WHERE path IN ('.auditrc', 'audit.config.json', '.auditrc.json') AND json_valid(content)),
policies AS (
  SELECT repo_id, path AS policy_file,
    coalesce((j->'$.ignoredPaths')::VARCHAR[], {sql_list(V.DEFAULT_IGNORED)}) AS ignored_paths,
    coalesce(j->>'$.failThreshold', 'HIGH') AS fail_threshold,
    (j->'$.enabledRules')::VARCHAR[] AS enabled_rules, (j->'$.disabledRules')::VARCHAR[] AS disabled_rules,
    coalesce((j->>'$.privacy.telemetry')::BOOLEAN, false) AS telemetry,
    coalesce((j->>'$.privacy.aiOptIn')::BOOLEAN, false) AS ai_opt_in
  FROM policy_files
  WHERE coalesce(j->>'$.failThreshold', 'HIGH') IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO')
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY rank) = 1)
"""
ORACLES["policies"] = f"""WITH {CORPUS}, {POLICIES}
SELECT repo_id, policy_file, array_to_string(ignored_paths, ',') AS ignored_paths, fail_threshold,
  array_to_string(enabled_rules, ',') AS enabled_rules, array_to_string(disabled_rules, ',') AS disabled_rules,
  telemetry, ai_opt_in FROM policies"""
ORACLES["ignored_paths_by_policy"] = f"""WITH {CORPUS}, {POLICIES},
rules AS (
  SELECT s.repo_id, s.path, unnest(coalesce(p.ignored_paths, {sql_list(V.DEFAULT_IGNORED)})) AS pattern
  FROM source s LEFT JOIN policies p USING (repo_id)),
dropped AS (
  SELECT DISTINCT repo_id, path FROM rules
  WHERE list_contains(string_split(path, '/'), pattern) OR path = pattern OR starts_with(path, pattern || '/'))
SELECT repo_id, path FROM source ANTI JOIN dropped USING (repo_id, path)"""

GITIGNORE = rf"""
ignore_lines AS (
  SELECT repo_id, {trim('text')} AS t
  FROM (SELECT repo_id, unnest(string_split_regex(content, '\r?\n')) AS text FROM source WHERE path = '.gitignore')),
patterns AS (
  SELECT DISTINCT repo_id, regexp_replace(regexp_replace(t, '^/', ''), '/$', '') AS pattern
  FROM ignore_lines WHERE t <> '' AND NOT starts_with(t, '#') AND regexp_replace(regexp_replace(t, '^/', ''), '/$', '') <> ''),
hidden AS (
  SELECT DISTINCT k.repo_id, k.path FROM source k JOIN patterns p USING (repo_id)
  WHERE list_contains(string_split(path, '/'), pattern) OR path = pattern OR starts_with(path, pattern || '/')),
discovered AS (SELECT * FROM kept ANTI JOIN hidden USING (repo_id, path))
"""
ORACLES["gitignore"] = f"WITH {CORPUS}, {GITIGNORE} SELECT repo_id, pattern FROM patterns"
ORACLES["gitignored_files"] = f"WITH {CORPUS}, {GITIGNORE} SELECT repo_id, path FROM source ANTI JOIN hidden USING (repo_id, path)"
TOKENS = rf"""
tokens AS (
  SELECT DISTINCT repo_id, {trim('text')} AS token
  FROM (SELECT repo_id, unnest(string_split_regex(content, '\r?\n')) AS text FROM source WHERE path = '.auditignore')
  WHERE {trim('text')} <> '' AND NOT starts_with({trim('text')}, '#'))
"""
ORACLES["suppressions"] = f"WITH {CORPUS}, {TOKENS} SELECT repo_id, token FROM tokens"

ORACLES["files_by_size"] = f"WITH {CORPUS} SELECT repo_id, path, length FROM source WHERE length <= 2000"

ORACLES["file_roles"] = f"""WITH {CORPUS}
SELECT repo_id, path, ext, {CODE} AS is_code,
  {has_any('path', 'api/', 'routes/', 'controllers/', 'views.py')} OR {ends_any('path', 'route.ts', 'route.js')} AS api_path,
  {has_any('path', 'api/', 'routes/')} OR {ends_any('path', 'route.ts', 'route.js')} AS auth_api_path,
  {has_any('path', 'admin', 'manage')} AS admin_path,
  {has_any('content', "'use client'", '"use client"')} OR contains(path, 'components/') OR {ends_any('path', '.tsx', '.jsx')} AS client_component,
  {has_any('path', 'test', 'spec')} AS log_skipped,
  {has_any('path', 'test', 'fixture', 'example', 'doc')} AS rel_test_doc,
  {has_any('path', 'test', 'fixture', 'example')} AS data_test,
  {has_any('path', 'config', 'settings', '.env.')} OR ends_with(path, '.env') AS config_path,
  contains(path, 'prod') AS prod_path, {DOCKER} AS is_dockerfile,
  contains(lower(base), 'docker-compose') OR contains(lower(base), 'compose.yaml') AS is_compose,
  {has_any('path', '.github/workflows', '.gitlab-ci')} AS is_ci,
  starts_with(base, '.env') AND path NOT IN ('.env.example', '.env.sample', '.env.template') AS env_file,
  ends_with(path, '.py') AS is_python
FROM files"""
ORACLES["content_flags"] = f"""WITH {CORPUS}
SELECT repo_id, path, contains(lower(content), 'jwt.verify') AS has_jwt_verify,
  {has_any('lower(content)', 'bcrypt', 'argon2', 'scrypt', 'hashpassword', 'pbkdf2')} AS has_hashing,
  contains(content, 'httpOnly') AS has_http_only, contains(lower(content), 'credentials') AS has_credentials,
  contains(content, 'req.body') AS has_body,
  {has_any('content', 'express', 'app.get', 'app.post', 'router.', 'req, res', 'NextResponse', 'NextApiRequest')} AS has_server_marker
FROM files"""
ORACLES["strip_comments"] = rf"""WITH {CORPUS},
code AS (SELECT repo_id, path, regexp_replace(content, '//.*|/\*[\s\S]*?\*/', '', 'g') AS c FROM files)
SELECT repo_id, path, md5(c) AS code_md5, length(c)::INT AS code_chars FROM code"""
ORACLES["comment_lines"] = f"""WITH {CORPUS}, {LINES}
SELECT repo_id, path, count(*) AS line_count, count(*) FILTER (WHERE comment) AS comment_count FROM ln GROUP BY 1, 2"""

# --- environment and dependencies ----------------------------------------------------------------

ENV = rf"""
example_lines AS (
  SELECT repo_id, {trim('text')} AS t
  FROM (SELECT repo_id, unnest(string_split_regex(content, '\r?\n')) AS text FROM files WHERE path = '.env.example')),
documented AS (
  SELECT DISTINCT repo_id, {trim("string_split(t, '=')[1]")} AS name FROM example_lines
  WHERE t <> '' AND NOT starts_with(t, '#')),
referenced AS (
  SELECT DISTINCT repo_id, name FROM (
    SELECT repo_id, unnest(regexp_extract_all(content, 'process\.env\.([A-Z0-9_]+)', 1)) AS name
    FROM files WHERE NOT {has_any('path', 'test', '.env')})
  WHERE name NOT IN ('NODE_ENV', 'PORT', 'HOST', 'TZ', 'PATH', 'PWD')),
undocumented AS (
  SELECT r.repo_id, r.name FROM referenced r
  WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo_id = r.repo_id AND f.path = '.env.example')
    AND NOT EXISTS (SELECT 1 FROM documented d WHERE d.repo_id = r.repo_id AND d.name = r.name)),
active AS (
  SELECT repo_id, min(path) AS path, arg_min(content, path) AS content FROM files
  WHERE path IN ('.env', '.env.local') GROUP BY repo_id),
missing AS (
  SELECT d.repo_id, a.path, d.name FROM documented d JOIN active a USING (repo_id)
  WHERE NOT contains(a.content, d.name || '='))
"""


def _name_list(table: str, path: str, ord_: int, label: str) -> str:
    ranges = f"""SELECT repo_id, sha256(name)[1:3] AS r, sha256(string_agg(sha256(name), '' ORDER BY sha256(name))) AS h FROM {table} GROUP BY ALL"""
    return f"""SELECT t.repo_id, {path} AS path, 1 AS line,
  {q(label + ": ")} || array_to_string(list_sort(list(name))[1:3], ', ') || ' (' || count(*) || ' in all)' AS text, {ord_} AS ord,
  any_value(i.x) AS fp_text
FROM {table} t JOIN (SELECT repo_id, sha256(string_agg(r || h, '' ORDER BY r)) AS x FROM ({ranges}) GROUP BY repo_id) i USING (repo_id)
GROUP BY t.repo_id"""


ENV_HITS = f"""
env_hits AS ({_name_list('undocumented', q('.env.example'), _o('CONFIG-007'), 'Undocumented variables')}
  UNION ALL {_name_list('missing', 'min(path)', _o('CONFIG-005'), 'Missing variables')})
"""
ORACLES["undocumented_env"] = f"WITH {CORPUS}, {ENV} SELECT repo_id, name FROM undocumented"
ORACLES["missing_env"] = f"WITH {CORPUS}, {ENV} SELECT repo_id, path, name FROM missing"
ORACLES["first_names"] = f"""WITH {CORPUS}, {ENV}
SELECT repo_id, array_to_string(list_sort(list(name))[1:3], ', ') AS first FROM referenced GROUP BY repo_id"""

DEPS = rf"""
package AS (
  SELECT repo_id, content::JSON AS j FROM source WHERE path = 'package.json' AND json_valid(content)),
package_keys AS (
  SELECT repo_id, name, coalesce(j->>('$.devDependencies."' || name || '"'), j->>('$.dependencies."' || name || '"')) AS version
  FROM (SELECT repo_id, j, unnest(list_distinct(list_concat(
      coalesce(json_keys(j, '$.dependencies'), []), coalesce(json_keys(j, '$.devDependencies'), [])))) AS name FROM package)),
lock AS (SELECT repo_id, content::JSON AS j FROM source WHERE path = 'package-lock.json' AND json_valid(content)),
lock_new AS (
  SELECT repo_id, coalesce(j->>('$.packages."' || k || '".name'), regexp_replace(k, '^node_modules/', '')) AS name,
    j->>('$.packages."' || k || '".version') AS version
  FROM (SELECT repo_id, j, unnest(json_keys(j, '$.packages')) AS k FROM lock WHERE json_exists(j, '$.packages')) WHERE k <> ''),
lock_old AS (
  SELECT repo_id, k AS name, j->>('$.dependencies."' || k || '".version') AS version
  FROM (SELECT repo_id, j, unnest(json_keys(j, '$.dependencies')) AS k FROM lock WHERE NOT json_exists(j, '$.packages'))),
lock_all AS (SELECT * FROM lock_new UNION ALL SELECT * FROM lock_old),
req_lines AS (
  SELECT repo_id, {trim('text')} AS t
  FROM (SELECT repo_id, unnest(string_split_regex(content, '\r?\n')) AS text FROM source WHERE path = 'requirements.txt')),
req AS (
  SELECT repo_id, regexp_extract(t, {q(V.REQUIREMENT_LINE)}, 1) AS name,
    nullif({trim(f"regexp_extract(t, {q(V.REQUIREMENT_LINE)}, 3)")}, '') AS version
  FROM req_lines WHERE t <> '' AND NOT starts_with(t, '#') AND regexp_matches(t, {q(V.REQUIREMENT_LINE)})),
inventory_all AS (
  SELECT repo_id, name, version, 'direct' AS type, 1 AS o, 'package.json' AS source_file FROM package_keys
  UNION ALL SELECT repo_id, name, version,
    CASE WHEN EXISTS (SELECT 1 FROM package_keys p WHERE p.repo_id = l.repo_id AND p.name = l.name) THEN 'direct' ELSE 'transitive' END,
    2, 'package-lock.json' FROM lock_all l
  UNION ALL SELECT repo_id, name, version, 'direct', 3, 'requirements.txt' FROM req),
inventory AS (
  SELECT repo_id, name, nullif(version, '') AS version, type, source_file FROM inventory_all
  QUALIFY row_number() OVER (PARTITION BY repo_id, name, coalesce(version, ''), type ORDER BY o) = 1)
"""
PKG_HITS = f"""
pkg_hits AS (
  SELECT repo_id, source_file AS path, 1 AS line, name || ': ' || coalesce(version, 'unpinned') AS text, ord, name AS fp_text
  FROM (
    SELECT *, {_o('PKG-002')} AS ord FROM inventory WHERE lower(name) IN ('node-serialize', 'serialize-javascript')
    UNION ALL SELECT *, {_o('PKG-011')} FROM inventory WHERE version IN ('*', 'latest')
    UNION ALL SELECT *, {_o('PKG-012')} FROM inventory
      WHERE starts_with(version, 'file:') OR starts_with(version, 'git+') OR starts_with(version, 'http')))
"""
ORACLES["dependencies"] = f"WITH {CORPUS}, {DEPS} SELECT repo_id, name, version, type, source_file FROM inventory"
ORACLES["dependency_counts"] = f"""WITH {CORPUS}, {DEPS}
SELECT repo_id, count(*) AS total_count, count(*) FILTER (WHERE type = 'direct') AS direct_count,
  count(*) FILTER (WHERE type = 'transitive') AS transitive_count FROM inventory GROUP BY repo_id"""
ORACLES["deny_listed"] = f"""WITH {CORPUS}, {DEPS}
SELECT i.*, d.reason FROM inventory i JOIN (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in V.DENY_LIST.items())}) d(bad, reason)
ON lower(i.name) = d.bad"""
ORACLES["advisories"] = f"""WITH {CORPUS}, {DEPS},
known AS (SELECT DISTINCT name, version, 'ADV-' || upper(name) AS advisory FROM lock_all)
SELECT i.name, i.version, i.repo_id, i.type, i.source_file, k.advisory, 'CONFIGURED' AS advisory_status
FROM inventory i LEFT JOIN known k ON k.name = i.name AND k.version = i.version"""
ORACLES["advisories_not_configured"] = f"""WITH {CORPUS}, {DEPS}
SELECT *, NULL::VARCHAR AS advisory, 'NOT_CONFIGURED' AS advisory_status FROM inventory"""

# --- discovery ---------------------------------------------------------------------------------------

TS = "ext IN ('.ts', '.tsx')"
JSF = "ext IN ('.js', '.jsx', '.mjs', '.cjs')"
ROUTE_FILE = f"""(({TS} AND ({has_any('path', 'api/', 'routes/')} OR base IN ('route.ts', 'route.tsx')))
  OR ({JSF} AND ({has_any('path', 'api/', 'routes/')} OR base IN ('route.js', 'route.jsx')))
  OR (ext = '.py' AND {has_any('path', 'api', 'routes', 'views')}))"""
CI_FILE = "(starts_with(path, '.github/workflows') OR path IN ('.gitlab-ci.yml', '.circleci/config.yml'))"
CONFIG_FILE = f"""({ends_any('base', '.config.js', '.config.ts', '.config.mjs', '.config.cjs')}
  OR base IN ('tsconfig.json', 'jsconfig.json', 'settings.py'))"""
DOCKER_FILE = "base IN ('Dockerfile', 'docker-compose.yml', 'docker-compose.yaml', '.dockerignore')"
MANIFEST_FILE = "base IN ('package.json', 'requirements.txt', 'pyproject.toml', 'Pipfile')"
MANAGER = """CASE base WHEN 'package-lock.json' THEN 'npm' WHEN 'yarn.lock' THEN 'yarn' WHEN 'pnpm-lock.yaml' THEN 'pnpm'
  WHEN 'bun.lockb' THEN 'bun' WHEN 'bun.lock' THEN 'bun' WHEN 'poetry.lock' THEN 'poetry' WHEN 'Pipfile.lock' THEN 'pipenv' END"""
API_DIR = "(dir IN ('api', 'app/api', 'pages/api', 'routes', 'controllers') OR ends_with(dir, '/api') OR ends_with(dir, '/routes'))"
DIR_NAME = "lower(regexp_extract(dir, '[^/]*$'))"
SOURCE_DIR = f"{DIR_NAME} IN ('src', 'app', 'pages', 'lib', 'components')"


def _dep(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(names, {q(n)})" for n in names) + ")"


DISCOVERY = f"""
dirs AS (
  SELECT DISTINCT repo_id, array_to_string(parts[1:n], '/') AS dir
  FROM (SELECT repo_id, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS n FROM discovered)),
visible_package AS (
  SELECT p.repo_id, list(k.name) FILTER (WHERE k.version <> '') AS names, map(list(k.name) FILTER (k.name IS NOT NULL),
    list(k.version) FILTER (k.name IS NOT NULL)) AS versions
  FROM package p JOIN discovered d ON d.repo_id = p.repo_id AND d.path = 'package.json'
  LEFT JOIN package_keys k ON k.repo_id = p.repo_id GROUP BY p.repo_id),
fw_all AS (
  SELECT repo_id, 0 AS phase, path AS place, 'Docker' AS name, NULL AS version, base || ' configuration present' AS evidence
    FROM discovered WHERE base IN ('Dockerfile', 'docker-compose.yml', 'docker-compose.yaml')
  UNION ALL SELECT repo_id, 0, dir, 'Supabase', NULL, 'supabase/ directory found' FROM dirs WHERE {DIR_NAME} = 'supabase'
  UNION ALL SELECT repo_id, 1, o, label, versions[dep], 'package.json dependency ' || dep || '@' || versions[dep]
    FROM visible_package, (VALUES ('0', 'next', 'Next.js'), ('1', 'react', 'React'), ('2', 'express', 'Express'),
      ('3', '@supabase/supabase-js', 'Supabase JS')) v(o, dep, label) WHERE list_contains(names, dep)
  UNION ALL SELECT repo_id, 1, '4', 'PostgreSQL', NULL,
    'PostgreSQL client (' || CASE WHEN {_dep('pg')} THEN 'pg' ELSE 'postgres' END || ') in package.json'
    FROM visible_package WHERE {_dep('pg', 'postgres', '@types/pg')}
  UNION ALL SELECT repo_id, 2, '0', 'FastAPI', NULL, 'fastapi specified in requirements.txt' FROM discovered
    WHERE path = 'requirements.txt' AND contains(lower(content), 'fastapi')
  UNION ALL SELECT repo_id, 2, '1', 'Flask', NULL, 'flask specified in requirements.txt' FROM discovered
    WHERE path = 'requirements.txt' AND contains(lower(content), 'flask')
  UNION ALL SELECT repo_id, 2, '2', 'PostgreSQL', NULL, 'driver for PostgreSQL (psycopg2/asyncpg) in requirements.txt' FROM discovered
    WHERE path = 'requirements.txt' AND {has_any('lower(content)', 'psycopg2', 'asyncpg')}
  UNION ALL SELECT repo_id, 3, '0', 'FastAPI', NULL, 'fastapi in pyproject.toml' FROM discovered
    WHERE path = 'pyproject.toml' AND contains(content, 'fastapi')
  UNION ALL SELECT repo_id, 3, '1', 'Flask', NULL, 'flask in pyproject.toml' FROM discovered
    WHERE path = 'pyproject.toml' AND contains(content, 'flask')),
frameworks AS (
  SELECT repo_id, name, version, 'HIGH' AS confidence, evidence FROM fw_all
  QUALIFY row_number() OVER (PARTITION BY repo_id, name, version ORDER BY phase DESC, place DESC) = 1),
facts AS (
  SELECT repo_id, count(*) AS total_files,
    count(*) FILTER ({TS} OR {JSF} OR ext = '.py') AS source_files,
    count(*) FILTER ({ROUTE_FILE}) AS routes_count, count(*) FILTER (ext = '.sql') AS tables_count,
    count(*) FILTER (starts_with(base, '.env')) AS env_files, count(*) FILTER ({CONFIG_FILE}) AS config_files,
    count(*) FILTER ({DOCKER_FILE}) AS docker_files, count(*) FILTER ({CI_FILE}) AS ci_files,
    count(*) FILTER ({MANIFEST_FILE}) AS package_manifests, count(*) FILTER (({MANAGER}) IS NOT NULL) AS lockfiles,
    min(path) FILTER ({MANIFEST_FILE}) AS first_manifest,
    arg_min({MANAGER}, path) FILTER (({MANAGER}) IS NOT NULL) AS lock_manager,
    bool_or({TS}) AS ts, bool_or({JSF}) AS js, bool_or(ext = '.py' OR path IN ('requirements.txt', 'pyproject.toml')) AS py,
    bool_or(ext = '.sql') AS sq, bool_or(path = 'tsconfig.json') AS tsconfig,
    bool_or(path = 'requirements.txt') AS has_req, bool_or(path = 'pyproject.toml') AS has_toml
  FROM discovered GROUP BY repo_id),
flags AS (
  SELECT f.*, p.repo_id IS NOT NULL AS has_pkg,
    f.ts OR (p.repo_id IS NOT NULL AND (coalesce({_dep('typescript')}, false) OR tsconfig)) AS is_ts
  FROM facts f LEFT JOIN visible_package p USING (repo_id)),
manifests AS (
  SELECT repo_id,
    array_to_string(list_filter([CASE WHEN js OR (has_pkg AND NOT is_ts) THEN 'JavaScript' END, CASE WHEN py THEN 'Python' END,
      CASE WHEN sq THEN 'SQL' END, CASE WHEN is_ts THEN 'TypeScript' END], lambda x: x IS NOT NULL), ',') AS languages,
    coalesce((SELECT array_to_string(list_sort(list(DISTINCT name)), ',') FROM frameworks w WHERE w.repo_id = flags.repo_id), '') AS frameworks,
    coalesce((SELECT bool_or(name IN ('Express', 'Next.js', 'Flask', 'FastAPI', 'Koa', 'NestJS')) FROM frameworks w
      WHERE w.repo_id = flags.repo_id), false) AS server_framework,
    coalesce(lock_manager, CASE WHEN has_pkg THEN 'npm (inferred)' WHEN has_req THEN 'pip' WHEN has_toml THEN 'poetry/pip' END) AS package_manager,
    lockfiles > 0 AS has_lockfile, first_manifest, package_manifests, lockfiles, env_files, config_files, docker_files, ci_files,
    (SELECT count(*) FROM dirs d WHERE d.repo_id = flags.repo_id AND {SOURCE_DIR}) AS source_dirs,
    (SELECT count(*) FROM dirs d WHERE d.repo_id = flags.repo_id AND {API_DIR}) AS api_dirs,
    routes_count, tables_count, source_files, total_files
  FROM flags)
"""
ORACLES["manifest"] = f"WITH {CORPUS}, {GITIGNORE}, {DEPS}, {DISCOVERY} SELECT * FROM manifests"
ORACLES["frameworks"] = f"WITH {CORPUS}, {GITIGNORE}, {DEPS}, {DISCOVERY} SELECT * FROM frameworks"
_DB_DEPS = [
    (("@supabase/supabase-js",), "'Supabase client'", "database"),
    (("pg", "postgres", "@types/pg"), f"'driver for PostgreSQL (' || CASE WHEN {_dep('pg')} THEN 'pg' ELSE 'postgres' END || ')'", "database"),
    (("prisma", "@prisma/client"), "'Prisma ORM'", "database"),
    (("drizzle-orm",), "'Drizzle ORM'", "database"),
    (("typeorm",), "'TypeORM'", "database"),
    (("mongoose",), "'Mongoose'", "database"),
    (("next-auth", "@auth/core"), f"'Auth.js (' || CASE WHEN {_dep('next-auth')} THEN 'next-auth' ELSE '@auth/core' END || ')'", "auth"),
    (("@clerk/nextjs", "@clerk/clerk-sdk-node"), "'Clerk'", "auth"),
    (("passport",), "'Passport.js'", "auth"),
    (("jsonwebtoken", "jose"), f"'JWT library (' || CASE WHEN {_dep('jsonwebtoken')} THEN 'jsonwebtoken' ELSE 'jose' END || ')'", "auth"),
    (("firebase-admin", "firebase"), "'Firebase Auth'", "auth"),
]
ORACLES["manifest_items"] = f"""WITH {CORPUS}, {GITIGNORE}, {DEPS}, {DISCOVERY}
SELECT DISTINCT repo_id, kind, value FROM (
  SELECT repo_id, 'env_file' AS kind, path AS value FROM discovered WHERE starts_with(base, '.env')
  UNION ALL SELECT repo_id, 'config_file', path FROM discovered WHERE {CONFIG_FILE}
  UNION ALL SELECT repo_id, 'docker_file', path FROM discovered WHERE {DOCKER_FILE}
  UNION ALL SELECT repo_id, 'ci_file', path FROM discovered WHERE {CI_FILE}
  UNION ALL SELECT repo_id, 'package_manifest', path FROM discovered WHERE {MANIFEST_FILE}
  UNION ALL SELECT repo_id, 'lockfile', path FROM discovered WHERE ({MANAGER}) IS NOT NULL
  UNION ALL SELECT repo_id, 'database', 'SQL files (' || path || ')' FROM discovered WHERE ext = '.sql'
  UNION ALL SELECT repo_id, 'source_dir', dir FROM dirs WHERE {SOURCE_DIR}
  UNION ALL SELECT repo_id, 'api_dir', dir FROM dirs WHERE {API_DIR}
  UNION ALL SELECT repo_id, 'database', 'Prisma files in prisma/' FROM dirs WHERE {DIR_NAME} = 'prisma'
  UNION ALL SELECT repo_id, 'database', 'Drizzle files in drizzle/' FROM dirs WHERE {DIR_NAME} = 'drizzle'
  UNION ALL SELECT repo_id, 'database', 'migrations below (' || dir || ')' FROM dirs WHERE {DIR_NAME} IN ('alembic', 'migrations')
  UNION ALL SELECT repo_id, 'database', 'Supabase files in supabase/' FROM dirs WHERE {DIR_NAME} = 'supabase'
  {' '.join(f"UNION ALL SELECT repo_id, {q(kind)}, {label} FROM visible_package WHERE {_dep(*names)}" for names, label, kind in _DB_DEPS)}
  UNION ALL SELECT repo_id, 'database', 'Python driver for PostgreSQL' FROM discovered
    WHERE path = 'requirements.txt' AND {has_any('lower(content)', 'psycopg2', 'asyncpg')}
  UNION ALL SELECT repo_id, 'database', 'SQLAlchemy ORM' FROM discovered WHERE path = 'requirements.txt' AND contains(lower(content), 'sqlalchemy')
  UNION ALL SELECT repo_id, 'auth', 'JWT library for Python' FROM discovered
    WHERE path = 'requirements.txt' AND {has_any('lower(content)', 'pyjwt', 'python-jose')}
  UNION ALL SELECT repo_id, 'auth', 'password hashing with Passlib' FROM discovered WHERE path = 'requirements.txt' AND contains(lower(content), 'passlib'))"""
ORACLES["languages"] = f"""WITH {CORPUS},
t AS (SELECT repo_id, CASE WHEN {TS} THEN 'TypeScript' WHEN {JSF} THEN 'JavaScript' WHEN ext = '.py' THEN 'Python'
  WHEN ext = '.sql' THEN 'SQL' END AS language FROM files)
SELECT repo_id, language, count(*) AS files FROM t WHERE language IS NOT NULL GROUP BY 1, 2"""

# --- repository rules ------------------------------------------------------------------------------------

SERVER_LIKE = f"""(({one_of('ext', '.js', '.ts', '.jsx', '.tsx')} OR base IN ('next.config.js', 'next.config.mjs'))
  AND {has_any('path', 'next.config', 'server', 'app')})"""
REPO_HITS = rf"""
repo_facts AS (
  SELECT repo_id, min(path) FILTER ({SERVER_LIKE}) AS server_file,
    bool_or({SERVER_LIKE} AND {m('content', V.SECURITY_HEADERS)}) AS headers,
    bool_or({CODE} AND ({' OR '.join(mc('content', p) for p in V.HEALTH_PATHS)})) AS health,
    bool_or({CODE} AND contains(content, 'SIGTERM') AND {has_any('content', 'SIGINT', 'process.on', 'server.close', 'app.close')}) AS shutdown,
    bool_or({CODE} AND ({mc('content', V.LOGGER_IMPORT)} OR {mc('content', V.LOGGER_REQUIRE)})) AS logger,
    count(*) FILTER ({has_any('lower(path)', '.test.', '.spec.', 'test_')} OR starts_with(lower(path), 'tests/')
      OR starts_with(lower(path), '__tests__/')) AS test_files,
    bool_or({has_any('lower(path)', '.github/workflows', '.gitlab-ci')} AND ({' OR '.join(m('content', p) for p in V.CI_TEST_STEPS)})) AS ci_tests,
    min(path) FILTER (path IN ('.env', '.env.local')) AS root_env
  FROM files GROUP BY repo_id),
repo_all AS (
  SELECT f.*, coalesce(m.routes_count, 0) AS rc, coalesce(m.package_manifests, 0) AS pm, coalesce(m.frameworks, '') AS fw, m.lockfiles,
    m.first_manifest, m.ci_files,
    (coalesce(m.server_framework, false) OR coalesce(m.routes_count, 0) > 0 OR coalesce(m.api_dirs, 0) > 0) AS server_app
  FROM repo_facts f LEFT JOIN manifests m USING (repo_id)),
repo_hits AS (
  SELECT repo_id, server_file AS path, 1 AS line, 'No security header setup found.' AS text, {_o('HDR-001')} AS ord, 'security-headers' AS fp_text
    FROM repo_all WHERE server_file IS NOT NULL AND NOT headers
  UNION ALL SELECT repo_id, root_env, 1, 'File path: ' || root_env, {_o('CFG-001')}, 'committed-env' FROM repo_all WHERE root_env IS NOT NULL
  UNION ALL SELECT repo_id, first_manifest, 1, 'Manifest without lockfile: ' || first_manifest, {_o('PKG-001')}, 'No lockfile found'
    FROM repo_all WHERE pm > 0 AND lockfiles = 0
  UNION ALL SELECT repo_id, NULL, NULL, rc || ' routes, no health endpoint.', {_o('OBS-001')}, NULL FROM repo_all WHERE server_app AND NOT health
  UNION ALL SELECT repo_id, NULL, NULL, 'No shutdown handler found.', {_o('OBS-002')}, NULL FROM repo_all WHERE server_app AND NOT shutdown
  UNION ALL SELECT repo_id, NULL, NULL, 'No structured logger found.', {_o('OBS-003')}, NULL FROM repo_all WHERE server_app AND NOT logger
  UNION ALL SELECT repo_id, NULL, NULL, 'No test files.', {_o('TST-001')}, NULL FROM repo_all
    WHERE (fw <> '' OR rc > 0 OR pm > 0) AND test_files = 0
  UNION ALL SELECT repo_id, NULL, NULL, test_files || ' test files, none run in the pipeline.', {_o('TST-002')}, NULL FROM repo_all
    WHERE (fw <> '' OR rc > 0 OR pm > 0) AND test_files > 0 AND ci_files > 0 AND NOT ci_tests)
"""

# --- routes -----------------------------------------------------------------------------------------------


def _inputs(vocabulary) -> str:
    cases = ", ".join(f"CASE WHEN {m('code', p)} THEN {q(n + '=' + s)} END" for n, s, p in vocabulary)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _finish(rows: str, vocabulary) -> str:
    seen = ", ".join(
        f"CASE WHEN {m('code', p)} THEN 'detected' ELSE 'not detected' END AS {n}"
        for n, p in (
            ("authentication", V.ROUTE_AUTH),
            ('"authorization"', V.ROUTE_AUTHORIZATION),
            ("database", V.ROUTE_DATABASE),
            ("external_calls", V.ROUTE_EXTERNAL),
        )
    )
    return f"""SELECT repo_id, method || ' ' || route_path AS route_id, method, route_path, file, line, framework, ins,
  authentication, "authorization", database, external_calls, array_to_string(list_filter([
    CASE WHEN authentication = 'not detected' THEN 'NO_AUTH' END, CASE WHEN "authorization" = 'not detected' THEN 'NO_AUTHORIZATION' END,
    CASE WHEN database = 'detected' AND "authorization" = 'not detected' THEN 'UNPROTECTED_DB_ACCESS' END],
    lambda x: x IS NOT NULL), ',') AS risk_flags
FROM (SELECT *, {_inputs(vocabulary)} AS ins, {seen} FROM ({rows}))"""


IS_APP = "regexp_matches(path, '^app/(.+)/route\\.[jt]sx?$')"
IS_PAGES = f"(regexp_matches(path, '^pages/api/(.+)\\.[jt]sx?$') AND NOT {IS_APP})"
_APP_METHODS = ", ".join(
    f"""CASE WHEN regexp_matches(content, 'export\\s+(async\\s+)?function\\s+{x}\\b|export\\s+const\\s+{x}\\b', 'i') THEN '{x}' END"""
    for x in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
)
NEXT_APP = _finish(
    f"""SELECT repo_id, path AS file, NULL::INT AS line, 'Next.js App Router' AS framework, content AS code,
  unnest(list_filter([{_APP_METHODS}], lambda x: x IS NOT NULL)) AS method,
  '/' || array_to_string(list_filter(string_split(regexp_extract(path, '^app/(.+)/route\\.[jt]sx?$', 1), '/'),
    lambda s: NOT (starts_with(s, '(') AND ends_with(s, ')'))), '/') AS route_path
FROM files WHERE {IS_APP} AND content <> ''""",
    V.NEXT_APP_INPUTS,
)
_PAGE_METHODS = ", ".join(
    f"""CASE WHEN regexp_matches(content, 'req\\.method\\s*===\\s*[''"]{x}[''"]', 'i') THEN '{x}' END"""
    for x in ("POST", "GET", "PUT", "DELETE")
)
NEXT_PAGES = _finish(
    f"""SELECT repo_id, path AS file, NULL::INT AS line, 'Next.js Pages Router' AS framework, content AS code,
  unnest(CASE WHEN len(found) > 0 THEN found ELSE ['GET', 'POST'] END) AS method,
  '/api/' || CASE sub WHEN 'index' THEN '' ELSE sub END AS route_path
FROM (SELECT *, list_filter([{_PAGE_METHODS}], lambda x: x IS NOT NULL) AS found,
    regexp_extract(path, '^pages/api/(.+)\\.[jt]sx?$', 1) AS sub FROM files WHERE {IS_PAGES} AND content <> '')""",
    V.JS_INPUTS,
)


def _sites(where: str, pattern: str) -> str:
    """Matches with their 0-based offset, found by adding up gaps and matches."""
    rx = q("(?i)" + pattern)
    return f"""SELECT *, (1 + length(before) - length(replace(before, chr(10), '')))::INT AS line,
  substring(content, greatest(1, pos - 199), pos + 1500 - greatest(0, pos - 200)) AS code
FROM (SELECT *, substring(content, 1, pos) AS before FROM (
  SELECT repo_id, path, content, mt, (sum(length(gap)) OVER w + sum(length(mt)) OVER w - length(mt))::BIGINT AS pos FROM (
    SELECT repo_id, path, content, unnest(ms) AS mt, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
    FROM (SELECT repo_id, path, content, regexp_extract_all(content, {rx}) AS ms, string_split_regex(content, {rx}) AS gaps
      FROM files WHERE {where}))
  WINDOW w AS (PARTITION BY repo_id, path ORDER BY i)))"""


def _part(pattern: str, n: int) -> str:
    return f"regexp_extract(mt, {q('(?i)' + pattern)}, {n})"


EXPRESS = _finish(
    f"""SELECT repo_id, path AS file, line, 'Express' AS framework, code, upper({_part(V.EXPRESS_ROUTE, 2)}) AS method,
  {_part(V.EXPRESS_ROUTE, 3)} AS route_path
FROM ({_sites(f"{ends_any('path', '.js', '.ts', '.mjs', '.cjs')} AND NOT {IS_APP} AND NOT {IS_PAGES}", V.EXPRESS_ROUTE)})""",
    V.JS_INPUTS,
)
PYTHON = _finish(
    f"""SELECT repo_id, path AS file, line, code, route_path,
  CASE WHEN verb = 'ROUTE' AND listed <> '' THEN 'Flask / FastAPI' ELSE 'FastAPI / Flask' END AS framework,
  unnest(CASE WHEN verb = 'ROUTE' AND listed <> '' THEN string_split(upper(regexp_replace(listed, '[''"\\s]', '', 'g')), ',')
    WHEN verb = 'ROUTE' THEN ['GET'] ELSE [verb] END) AS method
FROM (SELECT *, upper({_part(V.PYTHON_ROUTE, 2)}) AS verb, {_part(V.PYTHON_ROUTE, 3)} AS route_path, {_part(V.PYTHON_ROUTE, 4)} AS listed
  FROM ({_sites("ends_with(path, '.py')", V.PYTHON_ROUTE)}))""",
    V.PY_INPUTS,
)
_ROUTE_OUT = """repo_id, route_id, method, route_path, file, line, framework, array_to_string(ins, ',') AS inputs, authentication,
"authorization", database, external_calls, risk_flags"""
for _name, _body in (("next_app", NEXT_APP), ("next_pages", NEXT_PAGES), ("express", EXPRESS), ("python", PYTHON)):
    ORACLES[f"routes_{_name}"] = f"WITH {CORPUS} SELECT {_ROUTE_OUT} FROM ({_body})"
ROUTES = f"""
routes AS MATERIALIZED (SELECT * FROM ({NEXT_APP}) UNION ALL BY NAME SELECT * FROM ({NEXT_PAGES})
  UNION ALL BY NAME SELECT * FROM ({EXPRESS}) UNION ALL BY NAME SELECT * FROM ({PYTHON}))
"""
ORACLES["api_surface"] = f"WITH {CORPUS}, {ROUTES} SELECT repo_id, method, route_path, file, line, risk_flags FROM routes"

# --- the whole audit ------------------------------------------------------------------------------------------

AUDIT = f"""{hits_sql()}, {GITIGNORE}, {DEPS}, {DISCOVERY}, {REPO_HITS}, {PKG_HITS}, {ENV}, {ENV_HITS}, {ROUTES}, {CATALOG},
hits AS (
  SELECT repo_id, path, line, text, ord, NULL::VARCHAR AS fp_text FROM rule_hits
  UNION ALL BY NAME SELECT * FROM repo_hits UNION ALL BY NAME SELECT * FROM pkg_hits UNION ALL BY NAME SELECT * FROM env_hits),
{findings_sql('hits', 'raw')},
unsafe AS (
  SELECT DISTINCT repo_id, file FROM raw WHERE file IS NOT NULL AND (contains(rule_id, 'SQL') OR category = 'Database')),
corr_hits AS (
  SELECT r.repo_id, r.file AS path, coalesce(r.line, 1) AS line, {_o('CORR')} AS ord, route_id AS fp_text,
    'Route: ' || route_id || ' | Chain: INPUT (' || array_to_string(list_transform(ins, lambda i: string_split(i, '=')[1]), ', ')
      || ') -> DATABASE QUERY -> ' || CASE WHEN u.file IS NOT NULL THEN 'TEXT BUILT FROM INPUT' ELSE 'PARAMETERS NOT VERIFIED' END
      || ' -> NO RESOURCE AUTHORIZATION' AS text
  FROM routes r LEFT JOIN unsafe u ON u.repo_id = r.repo_id AND u.file = r.file
  WHERE len(ins) > 0 AND database = 'detected' AND "authorization" = 'not detected'
    AND (u.file IS NOT NULL OR authentication = 'not detected')),
{findings_sql('corr_hits', 'corr')},
every AS (SELECT {FINDING_LIST} FROM raw UNION ALL SELECT {FINDING_LIST} FROM corr),
uniq AS MATERIALIZED (
  SELECT * FROM every
  QUALIFY row_number() OVER (PARTITION BY repo_id, fingerprint ORDER BY coalesce(line, 0), ord, snippet) = 1)
"""
MARKERS = rf"""
marked AS (SELECT repo_id, path, string_split_regex(content, '\r?\n') AS ls FROM source),
marker_lines AS (SELECT repo_id, path, ls, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM marked),
file_markers AS (SELECT repo_id, path, x AS marker FROM marker_lines WHERE contains(x, 'audit-ignore-file')),
line_markers AS (
  SELECT repo_id, path, i AS line, coalesce(ls[i - 1], '') || chr(10) || x AS marker FROM marker_lines
    WHERE contains(x, 'audit-ignore-line') AND i > 1
  UNION ALL SELECT repo_id, path, i, chr(10) || x FROM marker_lines WHERE contains(x, 'audit-ignore-line') AND i = 1
  UNION ALL SELECT repo_id, path, i + 1, x || chr(10) || coalesce(ls[i + 1], '') FROM marker_lines WHERE contains(x, 'audit-ignore-line'))
"""
LISTED = """EXISTS (SELECT 1 FROM tokens t WHERE t.repo_id = u.repo_id AND t.token IN (u.rule_id, u.fingerprint))"""
INLINE = """(EXISTS (SELECT 1 FROM file_markers f WHERE f.repo_id = u.repo_id AND f.path = u.file AND contains(f.marker, u.rule_id))
  OR EXISTS (SELECT 1 FROM line_markers l WHERE l.repo_id = u.repo_id AND l.path = u.file AND l.line = u.line AND contains(l.marker, u.rule_id)))"""
FULL = f"""{AUDIT}, {TOKENS}, {MARKERS},
act AS MATERIALIZED (SELECT * FROM uniq u WHERE NOT {LISTED} AND NOT {INLINE}),
repos AS (SELECT DISTINCT repo_id FROM source)
"""

for _family in FAMILIES:
    chosen = set(family_rules(_family))
    if _family == "corr":
        ORACLES["rules_corr"] = f"""WITH {AUDIT} SELECT {SHORT} FROM corr
          QUALIFY row_number() OVER (PARTITION BY repo_id, fingerprint ORDER BY coalesce(line, 0), ord, snippet) = 1"""
    elif _family in ("pkg", "headers", "obs", "tst", "cfg", "config"):
        ids = ", ".join(q(r) for r in dict.fromkeys(RULES[i].rule_id for i in chosen))
        ORACLES[f"rules_{_family}"] = f"WITH {AUDIT} SELECT {SHORT} FROM raw WHERE rule_id IN ({ids})"
    else:
        ORACLES[f"rules_{_family}"] = family_sql(chosen)

ORACLES["dedup"] = f"WITH {AUDIT} SELECT {SHORT} FROM uniq"
ORACLES["suppress_list"] = f"WITH {AUDIT}, {TOKENS} SELECT {SHORT} FROM uniq u WHERE NOT {LISTED}"
ORACLES["suppress_inline"] = f"WITH {AUDIT}, {MARKERS} SELECT {SHORT} FROM uniq u WHERE NOT {INLINE}"
ORACLES["inline_markers"] = f"""WITH {CORPUS}, {MARKERS}
SELECT repo_id, path, 0 AS line, marker FROM file_markers UNION ALL SELECT repo_id, path, line::INT, marker FROM line_markers"""
ORACLES["filter_category"] = f"WITH {FULL} SELECT {SHORT} FROM act WHERE lower(category) = 'security'"
ORACLES["filter_severity"] = f"WITH {FULL} SELECT {SHORT} FROM act WHERE severity IN ('CRITICAL', 'HIGH')"
def _prose_values() -> str:
    from auditloom.operators.prose import RULE_PROSE

    return ", ".join(
        f"({', '.join(map(q, (rule, *texts[:-1], chr(10).join(texts.references), json.dumps(texts.references, separators=(',', ':')))))})"
        for rule, texts in RULE_PROSE.items()
    )


PROSE = f"""prose AS (SELECT * FROM (VALUES {_prose_values()})
  p(rule_id, description, impact, production_impact, remediation, confidence_reason, sources, sources_json))"""
ORACLES["search"] = f"""WITH {FULL}, {PROSE} SELECT {SHORT} FROM act JOIN prose USING (rule_id)
WHERE severity = 'CRITICAL' AND contains(lower(concat_ws(' ', title, rule_id, file, description)), 'sql')"""
ORACLES["sorted_findings"] = f"WITH {FULL} SELECT {SHORT} FROM act ORDER BY severity_rank DESC, repo_id, file, line"

# the same audit over the files each repository's own policy keeps
_BY_POLICY = FULL.replace(
    "files AS (SELECT * FROM kept WHERE length <= 1048576)",
    f"""{POLICIES},
dropped AS (
  SELECT DISTINCT repo_id, path FROM (
    SELECT s.repo_id, s.path, unnest(coalesce(p.ignored_paths, {sql_list(V.DEFAULT_IGNORED)})) AS pattern
    FROM source s LEFT JOIN policies p USING (repo_id))
  WHERE list_contains(string_split(path, '/'), pattern) OR path = pattern OR starts_with(path, pattern || '/')),
files AS (SELECT * FROM source ANTI JOIN dropped USING (repo_id, path) WHERE length <= 1048576)""",
).replace(
    "discovered AS (SELECT * FROM kept ANTI JOIN hidden USING (repo_id, path))",
    "discovered AS (SELECT * FROM source ANTI JOIN dropped USING (repo_id, path) ANTI JOIN hidden USING (repo_id, path))",
)
ORACLES["rule_policy"] = f"""WITH {_BY_POLICY}
SELECT {', '.join('u.' + c.strip() for c in SHORT.split(','))} FROM act u LEFT JOIN policies p USING (repo_id)
WHERE NOT list_contains(coalesce(p.disabled_rules, []), u.rule_id)
  AND (p.enabled_rules IS NULL OR list_contains(p.enabled_rules, u.rule_id))"""

NATURAL = f"""
firsts AS (SELECT *, row_number() OVER (PARTITION BY repo_id, fingerprint ORDER BY coalesce(line, 0), ord, snippet) AS rn FROM raw)
SELECT {SHORT} FROM firsts WHERE rn = 1"""


def _natural(files: str, families: set[str]) -> str:
    chosen = {i for i, r in enumerate(RULES) if r.family in families}
    body = family_sql(chosen).replace(f"WITH {CORPUS}", f"WITH {files}")
    head = body[: body.rindex("SELECT repo_id, rule_id, severity")]
    return head.rstrip() + "," + NATURAL


_NAMED = "regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext"
ORACLES["secrets_in_documents"] = _natural(
    f"""natural_files AS (SELECT source AS repo_id, 'doc_' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS length, text AS content FROM documents),
files AS (SELECT *, {_NAMED} FROM natural_files WHERE length <= 1048576)""",
    {"secret"},
)
ORACLES["config_in_pages"] = _natural(
    f"""natural_files AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo_id, 'prod/page_' || page_id || '.html' AS path,
  strlen(html)::BIGINT AS length, html AS content FROM pages),
files AS (SELECT *, {_NAMED} FROM natural_files WHERE length <= 1048576)""",
    {"config", "secret", "cfg"},
)
ORACLES["incremental"] = f"""{family_sql({i for i, r in enumerate(RULES) if r.scope != 'repo'})}
QUALIFY row_number() OVER (PARTITION BY repo_id, fingerprint ORDER BY coalesce(line, 0), ord, snippet) = 1"""
ORACLES["custom_rule"] = rf"""WITH {CORPUS}, {LINES},
s AS (SELECT *, {mask_sql('t')} AS snippet FROM ln WHERE {CODE} AND contains(text, 'settings'))
SELECT repo_id, 'USER-001' AS rule_id, 'LOW' AS severity, 'HIGH' AS confidence, path AS file, line, snippet,
  sha256('USER-001:' || path || ':Reliability:' || regexp_replace(t, '\s+', ' ', 'g'))[1:16] AS fingerprint FROM s"""

# --- scalar functions --------------------------------------------------------------------------------------------

ORACLES["fingerprints"] = rf"""WITH c AS (SELECT *, 'a/' || conv_id || '/t' || turn AS path FROM conversations)
SELECT conv_id, turn, path,
  sha256('CONV-001:' || path || ':' || role || ':' || regexp_replace({trim('text')}, '\s+', ' ', 'g'))[1:16] AS fingerprint FROM c"""
ORACLES["mask_documents"] = f"""WITH d AS (SELECT doc_id, text, {mask_sql('text')} AS masked FROM documents)
SELECT doc_id, md5(masked) AS masked_md5, masked <> text AS changed FROM d"""
ORACLES["mask_lines"] = f"""WITH {CORPUS}, {LINES}
SELECT repo_id, path, line, {mask_sql('text')} AS masked FROM ln WHERE regexp_matches(text, 'secret|key|token|pass|://', 'i')"""
ORACLES["mask_secrets"] = f"""WITH {CORPUS}, {LINES},
w AS (SELECT repo_id, path, line, string_split_regex(text, '[ ''"`;,]+') AS ws FROM ln WHERE regexp_matches(text, '[''"]')),
u AS (SELECT repo_id, path, line, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1)::INT AS n FROM w)
SELECT repo_id, path, line, n, {mask_secret_sql(trim('word'))} AS masked FROM u"""
ORACLES["strip_ansi_codes"] = f"""
SELECT conv_id, turn, regexp_replace(chr(27) || '[1;31m' || role || chr(27) || '[0m ' || text, {q(ANSI_CODE)}, '', 'g') AS plain
FROM conversations"""

# --- prose, baselines ------------------------------------------------------------------------------------------------


ORACLES["enriched"] = f"""WITH {FULL}, {PROSE}
SELECT repo_id, fingerprint, rule_id, title, category, subcategory, analyzer, severity_rank,
  description, impact, production_impact, remediation, confidence_reason, sources FROM act JOIN prose USING (rule_id)"""
ORACLES["explain"] = f"""WITH {FULL}, {PROSE},
one AS (
  SELECT *, coalesce(file, 'unknown') || ':' || coalesce(line, 1) AS place
  FROM act JOIN prose USING (rule_id) WHERE upper(rule_id) = 'CODE-004'
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(file, ''), coalesce(line, 0), fingerprint) = 1)
SELECT repo_id, fingerprint, (generate_subscripts(parts, 1) - 1)::INT AS position, unnest(parts).a AS section, unnest(parts).b AS body
FROM (SELECT repo_id, fingerprint, [
  {{'a': 'ID', 'b': rule_id}}, {{'a': 'TITLE', 'b': title}},
  {{'a': 'CATEGORY', 'b': category || CASE WHEN subcategory IS NULL THEN '' ELSE ' (' || subcategory || ')' END}},
  {{'a': 'SEVERITY', 'b': severity}}, {{'a': 'CONFIDENCE', 'b': confidence}}, {{'a': 'LOCATION', 'b': place}},
  {{'a': 'WHAT', 'b': description}}, {{'a': 'WHERE', 'b': place || ' | ' || snippet}},
  {{'a': 'WHY', 'b': confidence_reason}},
  {{'a': 'IMPACT', 'b': impact}}, {{'a': 'PRODUCTION', 'b': production_impact}}, {{'a': 'FIX', 'b': remediation}},
  {{'a': 'REFERENCES', 'b': sources}}] AS parts FROM one)"""
ORACLES["distinct_fingerprints"] = f"WITH {FULL} SELECT DISTINCT repo_id, fingerprint FROM act"
KNOWN = "known AS (SELECT DISTINCT repo_id, fingerprint FROM act WHERE severity IN ('CRITICAL', 'HIGH'))"
ORACLES["baseline_new"] = f"WITH {FULL}, {KNOWN} SELECT {SHORT} FROM act ANTI JOIN known USING (repo_id, fingerprint)"
ORACLES["baseline_stored"] = ORACLES["baseline_new"]
ORACLES["baseline_updated"] = f"{ORACLES['baseline_new']} WHERE length(repo_id) % 2 = 1"
ORACLES["baseline_known"] = f"WITH {FULL}, {KNOWN} SELECT {SHORT} FROM act SEMI JOIN known USING (repo_id, fingerprint)"
ORACLES["baseline_status"] = f"""WITH {FULL}, {KNOWN},
f AS (SELECT a.repo_id, k.fingerprint IS NOT NULL AS known FROM act a LEFT JOIN known k USING (repo_id, fingerprint) WHERE severity_rank >= 1),
t AS (SELECT repo_id, count(*) AS total, count(*) FILTER (NOT known) AS new, count(*) FILTER (known) AS old FROM f GROUP BY repo_id),
s AS (SELECT u.repo_id, count(*) - (SELECT count(*) FROM act a WHERE a.repo_id = u.repo_id) AS gone FROM uniq u GROUP BY u.repo_id)
SELECT s.repo_id, coalesce(total, 0)::BIGINT AS total_findings, coalesce(new, 0)::BIGINT AS new_findings,
  (coalesce(old, 0) + gone)::BIGINT AS suppressed_findings FROM s LEFT JOIN t USING (repo_id)"""

# --- scores ------------------------------------------------------------------------------------------------------------

POINTS = """floor(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 ELSE 0 END
  * CASE confidence WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END + 0.5::DOUBLE)::INT"""
PARTS = f"""
pts AS (SELECT *, {POINTS} AS p FROM picked),
parts AS (
  SELECT *, 'Security' AS dimension, p AS points FROM pts
    WHERE category IN ('Secrets', 'Security', 'Authentication', 'Authorization', 'Privacy')
  UNION ALL SELECT *, 'Reliability', p FROM pts WHERE category = 'Reliability' OR rule_id IN ('CODE-001', 'CODE-006')
  UNION ALL SELECT *, 'Configuration', p FROM pts WHERE category = 'Configuration'
  UNION ALL SELECT *, 'Dependencies', p FROM pts WHERE category = 'Dependencies'
  UNION ALL SELECT *, 'Architecture', p FROM pts WHERE category IN ('API', 'Database', 'Authorization')
  UNION ALL SELECT *, 'Production', floor(p * 0.75::DOUBLE + 0.5::DOUBLE)::INT FROM pts
    WHERE category = 'Configuration' OR severity IN ('CRITICAL', 'HIGH')),
contrib AS (SELECT * FROM parts WHERE p > 0)
"""
SCORED = f"""{PARTS},
dims AS (
  SELECT r.repo_id, {', '.join(f"greatest(0, 100 - coalesce((SELECT sum(points) FROM contrib c WHERE c.repo_id = r.repo_id AND dimension = '{d}'), 0))::INT AS {d.lower()}_score" for d in ('Security', 'Reliability', 'Configuration', 'Dependencies', 'Architecture', 'Production'))},
    {', '.join(f"(SELECT count(*) FROM picked c WHERE c.repo_id = r.repo_id AND severity = '{s}') AS {s.lower()}_count" for s in V.SEVERITIES)}
  FROM repos r),
overall AS (
  SELECT *, floor(security_score * 0.3::DOUBLE + production_score * 0.2::DOUBLE + configuration_score * 0.15::DOUBLE
    + architecture_score * 0.15::DOUBLE + dependencies_score * 0.1::DOUBLE + reliability_score * 0.1::DOUBLE + 0.5::DOUBLE)::INT AS overall_score
  FROM dims),
scored AS (
  SELECT *, CASE WHEN critical_count > 0 OR high_count > 2 OR overall_score < 70 THEN 'NOT_READY'
    WHEN high_count > 0 OR medium_count > 3 OR overall_score < 85 THEN 'NEEDS_ATTENTION' ELSE 'READY' END AS status
  FROM overall)
"""
ALL_PICKED = "picked AS (SELECT * FROM act)"
TEST_PICKED = "picked AS (SELECT * FROM act WHERE category = 'Testing')"
ORACLES["severity_counts"] = f"""WITH {FULL} SELECT repo_id,
  {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}_count" for s in V.SEVERITIES)} FROM act GROUP BY repo_id"""
ORACLES["contributions"] = f"""WITH {FULL}, {ALL_PICKED}, {PARTS}
SELECT repo_id, fingerprint, rule_id, title, category, severity, confidence, dimension, points FROM contrib"""
ORACLES["scores"] = f"WITH {FULL}, {ALL_PICKED}, {SCORED} SELECT * FROM scored"
ORACLES["scores_of_quiet_repos"] = f"WITH {FULL}, {TEST_PICKED}, {SCORED} SELECT * FROM scored"
ORACLES["readiness"] = f"""WITH {FULL}, {ALL_PICKED}, {SCORED},
has AS (SELECT repo_id, count(*) FILTER (category = 'Deployment') AS dep,
  count(*) FILTER (category = 'Deployment' AND severity IN ('CRITICAL', 'HIGH')) AS dep_high,
  count(*) FILTER (category = 'Observability') AS obs, count(*) FILTER (category = 'Observability' AND severity = 'HIGH') AS obs_high,
  count(*) FILTER (category = 'Testing') AS tst, count(*) FILTER (rule_id = 'TST-001') AS none FROM picked GROUP BY repo_id)
SELECT repo_id,
  CASE WHEN security_score >= 90 THEN 'READY' WHEN security_score >= 70 THEN 'NEEDS_ATTENTION' ELSE 'NOT_READY' END AS security,
  CASE WHEN reliability_score >= 90 THEN 'GOOD' WHEN reliability_score >= 75 THEN 'NEEDS_ATTENTION' ELSE 'LIMITED' END AS reliability,
  CASE WHEN configuration_score >= 90 THEN 'GOOD' WHEN configuration_score >= 75 THEN 'NEEDS_ATTENTION' ELSE 'INSECURE' END AS configuration,
  CASE WHEN dependencies_score >= 90 THEN 'GOOD' WHEN dependencies_score >= 75 THEN 'REVIEW' ELSE 'OUTDATED' END AS dependencies,
  CASE WHEN dep_high > 0 THEN 'RISKY' WHEN dep > 0 THEN 'LIMITED' ELSE 'GOOD' END AS deployment,
  CASE WHEN obs_high > 0 THEN 'MISSING' WHEN obs > 0 THEN 'LIMITED' ELSE 'GOOD' END AS observability,
  CASE WHEN none > 0 THEN 'NONE' WHEN tst > 0 THEN 'LIMITED' ELSE 'GOOD' END AS testing
FROM scored LEFT JOIN has USING (repo_id)"""
ORACLES["category_scores"] = f"""WITH {FULL}, {ALL_PICKED}, {SCORED}
SELECT s.repo_id, v.label AS category,
  CASE v.dim WHEN 'Security' THEN security_score WHEN 'Reliability' THEN reliability_score WHEN 'Configuration' THEN configuration_score
    WHEN 'Dependencies' THEN dependencies_score ELSE production_score END AS score,
  (SELECT count(*) FROM contrib c WHERE c.repo_id = s.repo_id AND c.dimension = v.dim) AS findings_count
FROM scored s, (VALUES ('Secrets', 'Security'), ('Reliability', 'Reliability'), ('Configuration', 'Configuration'),
  ('Dependencies', 'Dependencies'), ('Production', 'Production')) v(label, dim)"""
ORACLES["gate"] = f"""WITH {FULL}, {POLICIES}, {TEST_PICKED},
worst AS (SELECT repo_id, max(severity_rank) AS w FROM picked GROUP BY repo_id),
limits AS (SELECT r.repo_id, coalesce(p.fail_threshold, 'HIGH') AS severity FROM repos r LEFT JOIN policies p USING (repo_id))
SELECT l.repo_id, severity AS fail_threshold, CASE WHEN w IS NULL THEN 0 WHEN w >= {RANK} THEN 2 ELSE 1 END AS exit_code
FROM limits l LEFT JOIN worst USING (repo_id)"""
ORACLES["severity_share"] = f"""WITH {FULL}, {TEST_PICKED},
n AS (SELECT r.repo_id, s.severity, (SELECT count(*) FROM picked p WHERE p.repo_id = r.repo_id AND p.severity = s.severity) AS findings
  FROM repos r, (VALUES {', '.join(f'({q(s)})' for s in V.SEVERITIES)}) s(severity)),
t AS (SELECT *, sum(findings) OVER (PARTITION BY repo_id) AS total FROM n)
SELECT repo_id, severity, findings,
  CASE WHEN total = 0 THEN 0 ELSE floor(findings::DOUBLE / total::DOUBLE * 100 + 0.5)::INT END AS percent FROM t"""
ORACLES["analyzer_status"] = f"""WITH {FULL},
names AS (SELECT DISTINCT analyzer FROM catalog WHERE rule_id <> 'CORR')
SELECT r.repo_id, n.analyzer, 'completed' AS status,
  (SELECT count(*) FROM raw w WHERE w.repo_id = r.repo_id AND w.analyzer = n.analyzer) AS findings_count FROM repos r, names n"""

# --- correlation, flows, graph ----------------------------------------------------------------------------------------------

ORACLES["correlate"] = f"""WITH {AUDIT},
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line, fp_text, text) AS n FROM corr_hits)
SELECT repo_id, 'CORR-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS display_id, path, line,
  fp_text AS route_id, text FROM n"""
_SRC = q("(?i)" + V.SOURCE_ASSIGNMENT)
_KINDS = ", ".join(f"CASE WHEN {m('text', p)} THEN '{k}' END" for k, p in V.FLOW_SINKS.items())
ORACLES["flows"] = f"""WITH {CORPUS}, {LINES},
code AS (SELECT * FROM ln WHERE regexp_matches(path, '\\.(js|ts|jsx|tsx|py)$')),
src AS (
  SELECT repo_id, path, line, regexp_extract(text, {_SRC}, 1) AS var, regexp_extract(text, {_SRC}, 2) AS expr
  FROM code WHERE regexp_matches(text, {_SRC}) AND NOT regexp_matches(regexp_extract(text, {_SRC}, 1), '^[0-9]')),
sinks AS (
  SELECT repo_id, path, line, text, t, unnest(list_filter([{_KINDS}], lambda x: x IS NOT NULL)) AS kind,
    list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS words FROM code),
pairs AS (
  SELECT k.repo_id, k.path, k.line, k.text, k.t, k.kind, s.var, max(s.line) AS source_line, arg_max(s.expr, s.line) AS source_expr
  FROM sinks k JOIN src s ON s.repo_id = k.repo_id AND s.path = k.path AND s.line <= k.line AND list_contains(k.words, s.var)
  GROUP BY ALL)
SELECT repo_id, 'flow-' || kind || '-' || path || '-' || line AS flow_id, path AS file, kind, line AS sink_line, t AS sink_expr,
  var AS variable, source_expr, source_line, 'HIGH' AS confidence, false AS is_sanitized
FROM pairs WHERE kind <> 'sql' OR {has_any('text', '+', '`', '%', '.format(', 'f"')}"""
MODULES = f"""
modules AS (
  SELECT repo_id, path, base, regexp_matches(path, '\\.(js|ts|jsx|tsx|py|json)$') AS is_module,
    {m('content', V.GRAPH_DB)} AS db, {m('content', V.GRAPH_NETWORK)} AS net FROM files)
"""
ORACLES["graph_nodes"] = f"""WITH {CORPUS}, {ROUTES}, {MODULES},
route_nodes AS (
  SELECT repo_id, 'route:' || route_id AS node_id, 'route' AS node_type, route_id AS name, file, line FROM routes
  UNION ALL SELECT repo_id, 'input:' || route_id || ':' || string_split(i, '=')[1], 'input',
    string_split(i, '=')[1] || ' (' || string_split(i, '=')[2] || ')', file, line
  FROM (SELECT repo_id, route_id, file, line, unnest(ins) AS i FROM routes))
SELECT repo_id, 'file:' || path AS node_id, 'file' AS node_type, base AS name, path AS file, NULL::INT AS line FROM modules
UNION ALL SELECT repo_id, 'mod:' || path, 'module', path, path, NULL FROM modules WHERE is_module
UNION ALL SELECT repo_id, 'db:' || path, 'db_op', 'database use (' || base || ')', path, NULL FROM modules WHERE is_module AND db
UNION ALL SELECT repo_id, 'net:' || path, 'network_op', 'network use (' || base || ')', path, NULL FROM modules WHERE is_module AND net
UNION ALL SELECT repo_id, node_id, node_type, name, file, line FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, node_id ORDER BY file DESC, coalesce(line, 0) DESC) AS rn FROM route_nodes) WHERE rn = 1"""
ORACLES["graph_edges"] = f"""WITH {CORPUS}, {ROUTES}, {MODULES}
SELECT repo_id, 'file:' || path AS source_id, 'mod:' || path AS target_id, 'contains' AS relationship FROM modules WHERE is_module
UNION ALL SELECT repo_id, 'mod:' || path, 'db:' || path, 'queries_db' FROM modules WHERE is_module AND db
UNION ALL SELECT repo_id, 'mod:' || path, 'net:' || path, 'fetches_network' FROM modules WHERE is_module AND net
UNION ALL SELECT r.repo_id, 'mod:' || r.file, 'route:' || r.route_id, 'handles_route' FROM routes r
  JOIN modules m ON m.repo_id = r.repo_id AND m.path = r.file AND m.is_module
UNION ALL SELECT repo_id, 'route:' || route_id, 'input:' || route_id || ':' || string_split(i, '=')[1], 'accepts_input'
  FROM (SELECT repo_id, route_id, unnest(ins) AS i FROM routes)"""
ORACLES["graph_summary"] = f"""WITH {CORPUS}, {ROUTES}, {MODULES}
SELECT repo_id, (SELECT count(*) FROM routes r WHERE r.repo_id = m.repo_id) AS routes_count,
  count(*) FILTER (is_module) AS modules_count, count(*) FILTER (is_module AND net) AS external_calls_count,
  count(*) FILTER (is_module AND db) AS database_ops_count, count(*) AS files_count FROM modules m GROUP BY repo_id"""

# --- reports ---------------------------------------------------------------------------------------------------------------------

LEVEL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
ORACLES["sarif_results"] = f"""WITH {FULL}, {PROSE}
SELECT repo_id, rule_id, {LEVEL} AS level, coalesce(file, 'UNKNOWN') AS uri, coalesce(line, 1) AS start_line,
  title || ': ' || description AS message, fingerprint FROM act JOIN prose USING (rule_id)"""
ORACLES["sarif_rules"] = f"""WITH {FULL}, {PROSE}
SELECT repo_id, rule_id, regexp_replace(rule_id, '[^a-zA-Z0-9]', '', 'g') AS name, title AS short_description,
  description AS full_description, {LEVEL} AS level,
  description || chr(10) || chr(10) || 'Impact:' || chr(10) || impact || chr(10) || chr(10)
    || 'Remediation:' || chr(10) || remediation AS help
FROM act JOIN prose USING (rule_id)
QUALIFY row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY coalesce(file, ''), coalesce(line, 0), fingerprint) = 1"""

_FIELDS = """rule_id, title, category, subcategory, analyzer, severity, severity_rank, confidence, file, line, snippet, fingerprint"""
EVIDENCE = f"""
evidence AS (
  SELECT repo_id, fingerprint, '' AS item, file, line, snippet FROM act WHERE rule_id NOT IN ('CONFIG-005', 'CONFIG-007')
  UNION ALL SELECT a.repo_id, a.fingerprint, u.name, '.env.example', 1, u.name FROM act a JOIN undocumented u USING (repo_id) WHERE a.rule_id = 'CONFIG-007'
  UNION ALL SELECT a.repo_id, a.fingerprint, m.name, m.path, 1, m.name FROM act a JOIN missing m USING (repo_id) WHERE a.rule_id = 'CONFIG-005')
"""
ORACLES["evidence"] = f"WITH {FULL}, {EVIDENCE} SELECT repo_id, fingerprint, item, file, line, snippet FROM evidence"
_KNOWN_NONE = """SELECT u.repo_id, coalesce(a.n, 0) AS total_findings, coalesce(a.n, 0) AS new_findings, u.n - coalesce(a.n, 0) AS suppressed_findings
  FROM (SELECT repo_id, count(*) AS n FROM uniq GROUP BY repo_id) u LEFT JOIN (SELECT repo_id, count(*) AS n FROM act GROUP BY repo_id) a USING (repo_id)"""
ORACLES["baseline_status_without"] = f"WITH {FULL} {_KNOWN_NONE}"
ORACLES["gate_of_all"] = ORACLES["gate"].replace(TEST_PICKED, ALL_PICKED)
ORACLES["severity_share_of_all"] = ORACLES["severity_share"].replace(TEST_PICKED, ALL_PICKED)
_CODE_IDS = ", ".join(q(r) for r in dict.fromkeys(RULES[i].rule_id for i in family_rules("code")))
ORACLES["custom_analyzers"] = f"""{ORACLES["analyzer_status"]}
UNION ALL SELECT repo_id, 'own', 'completed', (SELECT count(*) FROM raw w WHERE w.repo_id = r.repo_id AND w.rule_id IN ({_CODE_IDS})) FROM repos r
UNION ALL SELECT repo_id, 'broken', 'failed', 0 FROM repos"""
_FLOWS_BODY = ORACLES["flows"].split(f"WITH {CORPUS}, {LINES},", 1)[1]
_FLOW_CTES, _FLOW_SELECT = _FLOWS_BODY.rsplit("SELECT repo_id, 'flow-'", 1)
_STEPS = """
steps AS (
  SELECT repo_id, file, sink_line AS line, string_agg(step, chr(10) ORDER BY step) AS how FROM (
    SELECT DISTINCT repo_id, file, sink_line, kind || ': ' || variable || ' at ' || file || ':' || source_line || ' is set from ' || source_expr
      || ', and at ' || file || ':' || sink_line || ' reaches ' || sink_expr AS step FROM flows)
  GROUP BY ALL)"""
_EXPLAINED = ORACLES["explain"].split(f"WITH {FULL}, {PROSE},", 1)[1]
ORACLES["explain_flows"] = f"""WITH {FULL}, {PROSE}, {_FLOW_CTES.strip()}, flows AS (SELECT repo_id, 'flow-'{_FLOW_SELECT}),{_STEPS},
one AS (
  SELECT *, coalesce(file, 'unknown') || ':' || coalesce(line, 1) AS place
  FROM act JOIN prose USING (rule_id) JOIN steps USING (repo_id, file, line))
SELECT{_EXPLAINED.split(" = 1)", 1)[1].split("SELECT", 1)[1]}""".replace("{'a': 'IMPACT'", "{'a': 'HOW', 'b': how}, {'a': 'IMPACT'")


def _entries(section: str, rows: str, key: str = "''", item: str = "''") -> str:
    return f"""SELECT repo_id, {q(section)} AS section, "key", item, field, "value" FROM (
  UNPIVOT (SELECT repo_id, {key} AS "key", {item} AS item, COLUMNS(* EXCLUDE (repo_id))::VARCHAR FROM ({rows}))
  ON COLUMNS(* EXCLUDE (repo_id, "key", item)) INTO NAME field VALUE "value")"""


def _joined(*columns: str) -> str:
    return " || chr(1) || ".join(f"coalesce(({c})::VARCHAR, '')" for c in columns)


_LINE = "lpad(coalesce(line, 0)::VARCHAR, 9, '0')"
_FINDING_KEY = _joined("9 - severity_rank", "file", _LINE, "fingerprint")
_SEVERITY_COUNTS = ", ".join(f"{s.lower()}_count" for s in V.SEVERITIES)


_REPORT = {
    "project": ("SELECT * FROM manifests", "''"),
    "scan_metadata": (
        f"""SELECT repo_id, 'HIGH' AS fail_threshold, CASE WHEN w IS NULL THEN 0 WHEN w >= 3 THEN 2 ELSE 1 END AS exit_code, 'auditloom' AS tool, '0.1.0' AS version
  FROM repos LEFT JOIN (SELECT repo_id, max(severity_rank) AS w FROM act GROUP BY repo_id) USING (repo_id)""",
        "''",
    ),
    "frameworks": ("SELECT * FROM frameworks", _joined("name", "version")),
    "dependencies": ("SELECT repo_id, name, version, type, source_file FROM inventory", _joined("name", "version", "type", "source_file")),
    "routes": (
        """SELECT repo_id, route_id, method, route_path, file, line, framework, authentication, "authorization", database, external_calls,
  '[' || array_to_string(list_transform(ins, lambda i: '{"name":"' || string_split(i, '=')[1] || '","source":"' || string_split(i, '=')[2] || '"}'), ',') || ']' AS inputs,
  CASE risk_flags WHEN '' THEN '[]' ELSE '["' || replace(risk_flags, ',', '","') || '"]' END AS risk_flags FROM routes""",
        _joined("file", _LINE, "route_id"),
    ),
    "baseline_status": (_KNOWN_NONE, "''"),
    "findings": (
        f"""SELECT repo_id, {_FIELDS}, description, impact, production_impact, remediation, confidence_reason,
  sources_json AS "references" FROM act JOIN prose USING (rule_id)""",
        _FINDING_KEY,
    ),
    "scores": ("SELECT * FROM scored", "''"),
    "explanations": (
        "SELECT repo_id, fingerprint, rule_id, title, category, severity, confidence, dimension, points FROM contrib",
        _joined("dimension", "fingerprint"),
    ),
    "summary": (f"SELECT repo_id, overall_score, status, {_SEVERITY_COUNTS} FROM scored", "''"),
}
_TWINS = {
    "technologies": ("manifest_items", _joined("kind", "value")),
    "dependency_counts": ("dependency_counts", "''"),
    "graph_summary": ("graph_summary", "''"),
    "readiness": ("readiness", "''"),
    "categories": ("category_scores", _joined("category")),
    "analyzers": ("analyzer_status", _joined("analyzer")),
}
_REPORT_ROWS = [_entries(name, rows, key) for name, (rows, key) in _REPORT.items()]


def _within(twin: str) -> str:
    """A twin without the table expressions that the report has already."""
    for shared in (f"{FULL}, {ALL_PICKED}, {SCORED}", f"{FULL}"):
        if ORACLES[twin].startswith(f"WITH {shared}"):
            rest = ORACLES[twin].removeprefix(f"WITH {shared}").strip()
            return f"WITH {rest[1:]}" if rest.startswith(",") else rest
    return ORACLES[twin]


_REPORT_ROWS += [_entries(name, f"SELECT * FROM ({_within(twin)})", key) for name, (twin, key) in _TWINS.items()]
_REPORT_ROWS.append(
    _entries(
        "evidence",
        f"SELECT repo_id, file, line, snippet, {_joined("9 - severity_rank", "act_file", _LINE.replace("line", "act_line"), "fingerprint")} AS __key, item AS __item FROM ("
        "SELECT e.*, a.severity_rank, a.file AS act_file, a.line AS act_line FROM evidence e JOIN act a USING (repo_id, fingerprint))",
        "__key",
        "__item",
    ).replace('COLUMNS(* EXCLUDE (repo_id))', 'COLUMNS(* EXCLUDE (repo_id, __key, __item))')
)
ORACLES["json_report"] = f"""WITH {FULL}, {PROSE}, {EVIDENCE}, {ALL_PICKED}, {SCORED}
{' UNION ALL '.join(_REPORT_ROWS)}"""
ORACLES["sarif_report"] = f"""WITH {FULL}, {PROSE},
rules AS ({ORACLES["sarif_rules"].split(PROSE, 1)[1]}),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY rule_id) - 1)::INT AS rule_index FROM rules)
SELECT repo_id, 'rules' AS section, rule_index, rule_id, level, help AS text, name AS place, NULL::INT AS start_line, full_description AS told FROM numbered
UNION ALL SELECT a.repo_id, 'results', n.rule_index, a.rule_id, {LEVEL.replace('severity', 'a.severity')}, a.title || ': ' || n.full_description,
  coalesce(a.file, 'UNKNOWN'), coalesce(a.line, 1), a.fingerprint FROM act a JOIN numbered n USING (repo_id, rule_id)"""
ORACLES["written_reports"] = f"""WITH {CORPUS}
SELECT repo_id, kind, repo_id || '.' || kind AS file, true AS filled FROM (SELECT DISTINCT repo_id FROM source), (VALUES ('json'), ('sarif')) k(kind)"""
