"""File columns used by the rules: extension, path roles and whole-file markers.

Every entry is one Column over ``path`` and ``content``; a query evaluates only
the ones its rules ask for, once per file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.regex import has
from auditloom.operators import fixed_values as V


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension; a leading dot alone (``.env``) is no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def path_has(*words: str) -> Column:
    return any_of(*[F.col("path").contains(w) for w in words])


def path_ends(*words: str) -> Column:
    return any_of(*[F.col("path").endswith(w) for w in words])


def content_has(*words: str) -> Column:
    return any_of(*[F.col("content").contains(w) for w in words])


def guarded(found: Column, words: Sequence[str], low: Column | None) -> Column:
    """``found``, a search of a whole file, tried only where the lower-case text holds one of ``words``, as every match does.

    ``low`` may be the lines that hold one of :data:`fixed_values.FILE_WORDS` alone, so ``words`` are all among these.
    """
    unknown = set(words).difference(V.FILE_WORDS)
    if unknown:
        raise ValueError(f"not in FILE_WORDS: {sorted(unknown)}")
    return found if low is None else any_of(*[low.contains(w) for w in words]) & found


def with_names(files: DataFrame) -> DataFrame:
    return files.withColumns({"base": basename(F.col("path")), "ext": extension(F.col("path"))})


def is_ci(path: Column) -> Column:
    return path.contains(".github/workflows") | path.contains(".gitlab-ci")


def file_flags(low: Column | None = None) -> dict[str, Callable[[], Column]]:
    """Named predicates over (path, base, ext, content); a query builds only those it uses.

    ``low`` is the content in lower case, or of it the lines that hold one of ``FILE_WORDS``, where a caller has it: word
    tests on it then run ahead of the searches.
    """
    ext, base, content = F.col("ext"), F.col("base"), F.col("content")
    lower_base = F.lower(base)
    return {
        # extension groups
        "is_code": lambda: ext.isin(*V.CODE_EXT),
        "is_js": lambda: ext.isin(*V.JS_EXT),
        "is_code_json": lambda: ext.isin(*V.CODE_EXT, ".json"),
        "is_unsafe_ext": lambda: ext.isin(*V.CODE_EXT, ".mjs"),
        "is_python": lambda: F.col("path").endswith(".py"),
        "is_reliability": lambda: ext.isin(*V.RELIABILITY_EXT),
        "is_misconfig": lambda: ext.isin(*V.MISCONFIG_EXT) | base.isin(*V.MISCONFIG_EXT),
        # path roles; each rule family has its own definition
        "api_path": lambda: path_has("api/", "routes/", "controllers/", "views.py") | path_ends("route.ts", "route.js"),
        "auth_api_path": lambda: path_has("api/", "routes/") | path_ends("route.ts", "route.js"),
        "admin_path": lambda: path_has("admin", "manage"),
        "id_path": lambda: path_has("[", ":id"),
        "client_component": lambda: content_has("'use client'", '"use client"')
        | path_has("components/")
        | path_ends(".tsx", ".jsx"),
        "log_skipped": lambda: path_has("test", "spec"),
        "rel_test_doc": lambda: path_has("test", "fixture", "example", "doc"),
        "data_test": lambda: path_has("test", "fixture", "example"),
        "config_path": lambda: path_has("config", "settings", ".env.") | path_ends(".env"),
        "prod_path": lambda: path_has("prod"),
        "test_path": lambda: path_has("test"),
        "is_dockerfile": lambda: lower_base.contains("dockerfile"),
        "is_compose": lambda: lower_base.contains("docker-compose") | lower_base.contains("compose.yaml"),
        "is_ci": lambda: is_ci(F.col("path")),
        "env_file": lambda: base.startswith(".env") & ~F.col("path").isin(*V.ENV_TEMPLATES),
        # whole-file markers
        "has_jwt_verify": lambda: guarded(has(content, V.JWT_VERIFY), V.JWT_VERIFY_WORDS, low),
        "has_hashing": lambda: guarded(has(content, V.PASSWORD_HASHING), V.PASSWORD_HASHING_WORDS, low),
        "has_http_only": lambda: guarded(content_has("httpOnly"), V.HTTP_ONLY_WORDS, low),
        "has_credentials": lambda: guarded(has(content, V.CORS_CREDENTIALS), V.CORS_CREDENTIALS_WORDS, low),
        "has_body": lambda: guarded(content_has("req.body"), V.BODY_WORDS, low),
        "has_server_marker": lambda: guarded(content_has(*V.SERVER_MARKERS), V.SERVER_WORDS, low),
        # 1-based place of the last handler, 0 if there is none
        "last_catch": lambda: F.when(
            content.contains(".catch("),
            F.length(content) - F.length(F.substring_index(content, ".catch(", -1)) - (len(".catch(") - 1),
        ).otherwise(0),
        # costly searches sit behind cheap tests of the only rule that asks
        "admin_guarded": lambda: path_has("admin", "manage") & has(content, V.ADMIN_GUARD),
        "unhashed_password": lambda: guarded(has(content, V.PASSWORD_FROM_REQUEST), V.PASSWORD_WORDS, low)
        & ~guarded(has(content, V.PASSWORD_HASHING), V.PASSWORD_HASHING_WORDS, low),
    }
