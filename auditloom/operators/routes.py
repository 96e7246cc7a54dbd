"""HTTP routes of four frameworks, with inputs, guards and risk flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.regex import has, java_pattern
from auditloom.operators import fixed_values as V
from auditloom.operators.digest import with_barrier
from auditloom.operators.roles import any_of, guarded

INPUTS = "array<struct<name:string,source:string>>"
ROUTE_COLUMNS = (
    "repo_id",
    "route_id",
    "method",
    "route_path",
    "file",
    "line",
    "framework",
    "inputs",
    "authentication",
    "authorization",
    "database",
    "external_calls",
    "risk_flags",
)


def detected(code: Column, pattern: str) -> Column:
    return F.when(has(code, pattern), F.lit("detected")).otherwise(F.lit("not detected"))


def route_inputs(code: Column, vocabulary: tuple) -> Column:
    found = [
        F.when(has(code, p), F.struct(F.lit(n).alias("name"), F.lit(s).alias("source"))) for n, s, p in vocabulary
    ]
    return F.array_compact(F.array(*found)).cast(INPUTS)


def risk_flags(authentication: Column, authorization: Column, database: Column) -> Column:
    no = "not detected"
    return F.array_compact(
        F.array(
            F.when(authentication == no, F.lit("NO_AUTH")),
            F.when(authorization == no, F.lit("NO_AUTHORIZATION")),
            F.when((database == "detected") & (authorization == no), F.lit("UNPROTECTED_DB_ACCESS")),
        )
    )


def _is_next_app() -> Column:
    return F.col("path").rlike(java_pattern(V.NEXT_APP_PATH))


def _is_next_pages() -> Column:
    return F.col("path").rlike(java_pattern(V.NEXT_PAGES_PATH)) & ~_is_next_app()


def may_route(low: Column | None = None) -> Column:
    """Files any route form can come from; later steps need only their contents. ``low`` as in :func:`file_flags`."""
    content, path = F.col("content"), F.col("path")
    express = guarded(has(content, V.EXPRESS_ROUTE), V.EXPRESS_ROUTE_WORDS, low)
    python = guarded(has(content, V.PYTHON_ROUTE), V.PYTHON_ROUTE_WORDS, low)
    script = any_of(*[path.endswith(e) for e in V.EXPRESS_EXT]) & express
    return _is_next_app() | _is_next_pages() | script | (path.endswith(".py") & python)


def _finish(rows: DataFrame, vocabulary: tuple) -> DataFrame:
    """Rows (repo_id, path, method, route_path, line, framework, code) to routes; the code is dropped here."""
    code = F.col("code")
    seen = rows.select(
        "repo_id",
        F.concat_ws(" ", "method", "route_path").alias("route_id"),
        "method",
        "route_path",
        F.col("path").alias("file"),
        "line",
        "framework",
        route_inputs(code, vocabulary).alias("inputs"),
        detected(code, V.ROUTE_AUTH).alias("authentication"),
        detected(code, V.ROUTE_AUTHORIZATION).alias("authorization"),
        detected(code, V.ROUTE_DATABASE).alias("database"),
        detected(code, V.ROUTE_EXTERNAL).alias("external_calls"),
    )
    flags = risk_flags(F.col("authentication"), F.col("authorization"), F.col("database"))
    return seen.withColumn("risk_flags", flags).select(*ROUTE_COLUMNS)


def routes_next_app(files: DataFrame) -> DataFrame:
    sub = F.regexp_extract("path", java_pattern(V.NEXT_APP_PATH), 1)
    kept = F.filter(F.split(sub, "/"), lambda s: ~(s.startswith("(") & s.endswith(")")))
    exported = [
        F.when(
            has(F.col("content"), rf"export\s+(async\s+)?function\s+{m}\b|export\s+const\s+{m}\b"),
            F.lit(m),
        )
        for m in V.NEXT_APP_METHODS
    ]
    rows = files.filter(_is_next_app() & (F.col("content") != "")).select(
        "repo_id",
        "path",
        F.explode_outer(F.array_compact(F.array(*exported))).alias("method"),
        F.concat(F.lit("/"), F.array_join(kept, "/")).alias("route_path"),
        F.lit(None).cast("int").alias("line"),
        F.lit("Next.js App Router").alias("framework"),
        F.col("content").alias("code"),
    )
    return _finish(rows.filter(F.col("method").isNotNull()), V.NEXT_APP_INPUTS)


def routes_next_pages(files: DataFrame) -> DataFrame:
    sub = F.regexp_extract("path", java_pattern(V.NEXT_PAGES_PATH), 1)
    tested = F.array_compact(
        F.array(
            *[
                F.when(has(F.col("content"), rf"""req\.method\s*===\s*['"]{m}['"]"""), F.lit(m))
                for m in V.NEXT_PAGES_METHODS
            ]
        )
    )
    methods = F.when(F.size(tested) > 0, tested).otherwise(F.array(F.lit("GET"), F.lit("POST")))
    rows = files.filter(_is_next_pages() & (F.col("content") != "")).select(
        "repo_id",
        "path",
        F.explode_outer(methods).alias("method"),
        F.concat(F.lit("/api/"), F.when(sub == "index", F.lit("")).otherwise(sub)).alias("route_path"),
        F.lit(None).cast("int").alias("line"),
        F.lit("Next.js Pages Router").alias("framework"),
        F.col("content").alias("code"),
    )
    return _finish(rows, V.JS_INPUTS)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _call_sites(files: DataFrame, pattern: str, first: str, head: str, groups: dict[str, int]) -> DataFrame:
    """One row per match of ``pattern``: its groups, its line and the code around it.

    The context comes from look-around groups at the match start (200 characters
    before, 1500 from there), so a file is never sliced once per match. ``first`` holds the
    characters that a match starts with, tested ahead of the words; groups come from the
    texts of the matches, as the pattern does not look around them.
    """
    body = f"(?=[{first}])" + java_pattern(pattern)
    plain = f"(?i){body}"
    around = (
        rf"(?i)(?=[{first}])(?={head})(?:(?<=([\s\S]{{{V.BLOCK_BEFORE}}}))|(?<=(^[\s\S]{{0,{V.BLOCK_BEFORE - 1}}})))"
        rf"(?=([\s\S]{{0,{V.BLOCK_AFTER}}})){body}"
    )
    content = F.col("content")

    def group(n: int) -> Column:
        return F.regexp_extract_all(content, F.lit(around), n)

    gaps = F.transform(F.split(content, plain), _newlines)
    matched = F.col("matched")
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(matched, _newlines).alias("own"))
    start = F.expr("named_struct('seen', 0, 'at', cast(array() as array<int>))")
    lines = F.aggregate(
        F.filter(steps, lambda s: s["own"].isNotNull()),
        start,
        lambda acc, s: F.struct(
            (acc["seen"] + s["gap"] + s["own"]).alias("seen"),
            F.concat(acc["at"], F.array(acc["seen"] + s["gap"] + 1)).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    zipped = F.arrays_zip(
        lines.alias("line"),
        group(1).alias("far"),
        group(2).alias("near"),
        group(3).alias("after"),
        matched.alias("text"),
    )
    found = with_barrier(files.filter(content.rlike(plain)), {"matched": F.regexp_extract_all(content, F.lit(plain), 0)})
    return (
        found.select("repo_id", "path", F.explode_outer(zipped).alias("m"))
        .select(
            "repo_id",
            "path",
            "m.line",
            F.concat("m.far", "m.near", "m.after").alias("code"),
            *[F.regexp_extract("m.text", plain, n).alias(name) for name, n in groups.items()],
        )
    )


def routes_express(files: DataFrame) -> DataFrame:
    scripts = files.filter(
        any_of(*[F.col("path").endswith(e) for e in V.EXPRESS_EXT]) & ~_is_next_app() & ~_is_next_pages()
    )
    sites = _call_sites(scripts, V.EXPRESS_ROUTE, "ars", r"(?:app|router|server)\.", {"method": 2, "route_path": 3})
    rows = sites.withColumn("method", F.upper("method")).withColumn("framework", F.lit("Express"))
    return _finish(rows, V.JS_INPUTS)


def routes_python(files: DataFrame) -> DataFrame:
    scripts = files.filter(F.col("path").endswith(".py"))
    sites = _call_sites(
        scripts, V.PYTHON_ROUTE, "@", r"@(?:app|router)\.", {"verb": 2, "route_path": 3, "listed": 4}
    )
    fan_out = (F.lower("verb") == "route") & (F.col("listed") != "")
    names = F.split(F.upper(F.regexp_replace("listed", java_pattern(r"""['"\s]"""), "")), ",")
    single = F.array(F.when(F.lower("verb") == "route", F.lit("GET")).otherwise(F.upper("verb")))
    rows = sites.withColumns(
        {
            "framework": F.when(fan_out, F.lit("Flask / FastAPI")).otherwise(F.lit("FastAPI / Flask")),
            "methods": F.when(fan_out, names).otherwise(single),
        }
    ).select("repo_id", "path", "line", "code", "route_path", "framework", F.explode_outer("methods").alias("method"))
    return _finish(rows, V.PY_INPUTS)


def routes(files: DataFrame) -> DataFrame:
    return (
        routes_next_app(files)
        .unionByName(routes_next_pages(files))
        .unionByName(routes_express(files))
        .unionByName(routes_python(files))
    )


def api_surface(found: DataFrame) -> DataFrame:
    return found.select(
        "repo_id", "method", "route_path", "file", "line", F.array_join("risk_flags", ",").alias("risk_flags")
    )
