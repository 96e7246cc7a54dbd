"""Rules about what a whole repository lacks: headers, health, shutdown, logs, tests, lockfile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.regex import has, has_cs
from auditloom.operators import fixed_values as V
from auditloom.operators.roles import any_of, guarded, is_ci, path_has, with_names
from auditloom.operators.rules import ordinals


def file_facts(low: Column | None = None) -> dict[str, Column]:
    """Per-file answers to the repository questions, over (path, base, ext, content); ``low`` as in :func:`file_flags`."""
    path, content = F.col("path"), F.col("content")
    lower = F.lower(path)
    code = F.col("ext").isin(*V.CODE_EXT)
    server_like = F.col("ext").isin(*V.JS_EXT) | F.col("base").isin("next.config.js", "next.config.mjs")
    server_like = server_like & path_has("next.config", "server", "app")
    test_file = any_of(*[lower.contains(w) for w in (".test.", ".spec.", "test_")]) | any_of(
        *[lower.startswith(w) for w in ("tests/", "__tests__/")]
    )
    return {
        "f_server": server_like,
        "f_headers": server_like & guarded(has(content, V.SECURITY_HEADERS), V.SECURITY_HEADERS_WORDS, low),
        "f_health": code & guarded(any_of(*[has_cs(content, p) for p in V.HEALTH_PATHS]), V.HEALTH_WORDS, low),
        "f_shutdown": code & guarded(content.contains("SIGTERM"), ("sigterm",), low) & has_cs(content, V.SHUTDOWN_HOOKS),
        "f_logger": code & guarded(has_cs(content, V.LOGGER_IMPORT) | has_cs(content, V.LOGGER_REQUIRE), V.LOGGER_WORDS, low),
        "f_test": test_file,
        "f_ci_tests": is_ci(lower) & any_of(*[has(content, p) for p in V.CI_TEST_STEPS]),
    }


def repo_facts(per_file: DataFrame) -> DataFrame:
    """One row per repository from rows (repo_id, path, f_...); combined before the shuffle."""
    path = F.col("path")
    return per_file.groupBy("repo_id").agg(
        F.min(F.when(F.col("f_server"), path)).alias("server_file"),
        F.bool_or("f_headers").alias("headers"),
        F.bool_or("f_health").alias("health"),
        F.bool_or("f_shutdown").alias("shutdown"),
        F.bool_or("f_logger").alias("logger"),
        F.count_if(F.col("f_test")).alias("test_files"),
        F.bool_or("f_ci_tests").alias("ci_tests"),
        F.min(F.when(path.isin(*V.ROOT_ENV_FILES), path)).alias("root_env"),
    )


def facts_of(files: DataFrame) -> DataFrame:
    return repo_facts(with_names(files).select("repo_id", "path", *[c.alias(n) for n, c in file_facts().items()]))


def repo_hits(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Repository-scope hits from :func:`repo_facts` and the manifests."""
    all_facts = facts.join(manifests, "repo_id", "left")
    routes = F.coalesce(F.col("routes_count"), F.lit(0))
    packages = F.coalesce(F.col("package_manifests"), F.lit(0))
    server_app = F.coalesce(F.col("server_framework"), F.lit(False)) | (routes > 0) | (
        F.coalesce(F.col("api_dirs"), F.lit(0)) > 0
    )
    app = (F.coalesce(F.col("frameworks"), F.lit("")) != "") | (routes > 0) | (packages > 0)
    null_text = F.lit(None).cast("string")
    null_line = F.lit(None).cast("int")

    def hit(rule_id: str, when: Column, path: Column, line: Column, text: Column, fp_text: Column) -> Column:
        return F.when(
            when,
            F.struct(
                path.alias("path"),
                line.alias("line"),
                text.alias("text"),
                F.lit(ordinals(rule_id)[0]).alias("ord"),
                fp_text.alias("fp_text"),
            ),
        )

    one = F.lit(1)
    no_path = null_text
    hits = [
        hit("HDR-001", F.col("server_file").isNotNull() & ~F.col("headers"), F.col("server_file"), one,
            F.lit("No security header setup found."), F.lit("security-headers")),
        hit("CFG-001", F.col("root_env").isNotNull(), F.col("root_env"), one,
            F.concat(F.lit("File path: "), F.col("root_env")), F.lit("committed-env")),
        hit("PKG-001", (packages > 0) & (F.col("lockfiles") == 0), F.col("first_manifest"), one,
            F.concat(F.lit("Manifest without lockfile: "), F.col("first_manifest")), F.lit("No lockfile found")),
        hit("OBS-001", server_app & ~F.col("health"), no_path, null_line,
            F.concat(routes.cast("string"), F.lit(" routes, no health endpoint.")), null_text),
        hit("OBS-002", server_app & ~F.col("shutdown"), no_path, null_line,
            F.lit("No shutdown handler found."), null_text),
        hit("OBS-003", server_app & ~F.col("logger"), no_path, null_line,
            F.lit("No structured logger found."), null_text),
        hit("TST-001", app & (F.col("test_files") == 0), no_path, null_line, F.lit("No test files."), null_text),
        hit("TST-002", app & (F.col("test_files") > 0) & (F.col("ci_files") > 0) & ~F.col("ci_tests"), no_path, null_line,
            F.concat(F.col("test_files").cast("string"), F.lit(" test files, none run in the pipeline.")), null_text),
    ]
    return all_facts.select("repo_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("repo_id", "h.*")
