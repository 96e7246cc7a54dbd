"""Reading files tables, path filters, per-repository policies and ignore lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.regex import strip
from auditloom.operators import fixed_values as V
from auditloom.operators.digest import split_lines
from auditloom.operators.roles import basename, extension
from auditloom.sources.tree import list_tree, read_listed

POLICY_SCHEMA = (
    "ignoredPaths array<string>, failThreshold string, enabledRules array<string>, disabledRules array<string>,"
    " privacy struct<telemetry:boolean,aiOptIn:boolean>, _bad string"
)


def scan_files(
    spark: SparkSession, root: str, max_bytes: int | None = None, hidden: bool = True, prune: Iterable[str] = ()
) -> DataFrame:
    """Every file below ``root/<repo_id>/`` as (repo_id, path, length, content).

    Names are listed by tasks that take directories, see :func:`list_tree`. Files of any
    size are read; a limit, where given, is pushed into the listing's read, so larger files
    are not opened. ``hidden=False`` leaves out dot and underscore files; directories named in
    ``prune`` are not even listed. Bytes that are no UTF-8 become replacement characters.
    """
    listed = list_tree(spark, root, prune)
    if max_bytes is not None:
        listed = listed.filter(F.col("length") <= max_bytes)
    if not hidden:
        listed = listed.filter(~F.col("path").rlike("(^|/)[._]"))
    return read_listed(listed, root)


def read_files_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("repo_id", "path", "length", "content")


def write_files_table(files: DataFrame, path: str) -> None:
    """Store a files table so that extension filters prune whole folders."""
    files.withColumn("ext", extension(F.col("path"))).write.mode("overwrite").partitionBy("ext").parquet(path)


def filter_size(files: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    return files.filter(F.col("length") <= max_bytes)


def filter_extension(files: DataFrame, names: list[str]) -> DataFrame:
    """Keep by lower-case extension or by exact file name."""
    return files.filter(extension(F.col("path")).isin(names) | basename(F.col("path")).isin(names))


def path_prefixes(path: Column) -> Column:
    """``a/b/c`` -> [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _clean_pattern(pattern: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(pattern, F.lit("\\"), F.lit("/")), "^/", ""), "/\\z", "")


BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 64 * 1024 * 1024
ROOT_FILES = (
    "package.json",
    "package-lock.json",
    "requirements.txt",
    "pyproject.toml",
    ".env.example",
    *V.ROOT_ENV_FILES,
    ".gitignore",
    V.IGNORE_FILE,
    *V.POLICY_FILES,
)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Broadcast ``df`` when a bounded count proves it small in rows and text.

    Beyond the bound the join stays as it is: a shuffle join whose hot keys AQE splits.
    """
    width = F.length(F.to_json(F.struct(*df.columns)))
    rows, chars = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and chars <= max_chars else df


def filter_ignored_paths(files: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Drop files under an ignored name or path.

    A name matches any path segment, a path matches itself and everything below.
    Repositories without a policy row use the default names. The join is on
    repo_id with one policy row per repository; the ignore test itself is a
    per-row array expression, so no pair of file and pattern is materialised.
    """
    default = F.array(*[F.lit(n) for n in V.DEFAULT_IGNORED])
    if policies is None:
        names = "|".join(n.replace(".", "\\.") for n in V.DEFAULT_IGNORED)
        return files.filter(~F.col("path").rlike(f"(?:^|/)(?:{names})(?:/|\\z)"))
    source = files.join(small_side(policies.select("repo_id", "ignored_paths")), "repo_id", "left")
    ignored = F.coalesce(F.col("ignored_paths"), default)
    parts = F.split(F.col("path"), "/")
    cleaned = F.filter(F.transform(ignored, _clean_pattern), lambda p: p != "")
    below = F.exists(
        cleaned, lambda p: (F.col("path") == p) | F.col("path").startswith(F.concat(p, F.lit("/")))
    )
    dropped = F.arrays_overlap(parts, ignored) | F.arrays_overlap(path_prefixes(F.col("path")), ignored) | below
    return source.filter(~F.coalesce(dropped, F.lit(False))).select(*files.columns)


def gitignore_patterns(files: DataFrame) -> DataFrame:
    """(repo_id, pattern): literal names and paths of the root ``.gitignore``."""
    line = strip(F.col("text"))
    return (
        files.filter(F.col("path") == ".gitignore")
        .select("repo_id", F.explode(split_lines(F.col("content"))).alias("text"))
        .filter((line != "") & ~line.startswith("#"))
        .select(
            "repo_id",
            F.regexp_replace(F.regexp_replace(line, "^/", ""), "/\\z", "").alias("pattern"),
        )
        .filter(F.col("pattern") != "")
        .distinct()
    )


def filter_gitignored(files: DataFrame) -> DataFrame:
    """Drop files matched by their own repository's ``.gitignore`` (names or path prefixes).

    Each path becomes its segments and prefixes, which equi-join the patterns on
    (repo_id, pattern); only the few matching paths come back for the anti-join.
    """
    probes = files.select(
        "repo_id",
        "path",
        F.explode(F.array_distinct(F.concat(F.split("path", "/"), path_prefixes(F.col("path"))))).alias("pattern"),
    )
    patterns = small_side(gitignore_patterns(files))
    hidden = probes.join(patterns, ["repo_id", "pattern"], "left_semi").select("repo_id", "path").distinct()
    return files.join(small_side(hidden), ["repo_id", "path"], "left_anti")


def load_policies(files: DataFrame) -> DataFrame:
    """The first valid policy file of each repository, by file precedence."""
    rank = F.array_position(F.array(*[F.lit(n) for n in V.POLICY_FILES]), F.col("path"))
    parsed = F.from_json(F.col("content"), POLICY_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    threshold = F.coalesce(F.col("p.failThreshold"), F.lit(V.DEFAULT_FAIL_THRESHOLD))
    return (
        files.filter(F.col("path").isin(*V.POLICY_FILES))
        .select("repo_id", "path", rank.alias("rank"), parsed.alias("p"))
        .filter(F.col("p").isNotNull() & F.col("p._bad").isNull() & threshold.isin(*V.SEVERITIES))
        .groupBy("repo_id")
        .agg(F.min_by(F.struct("path", "p"), "rank").alias("best"))
        .select(
            "repo_id",
            F.col("best.path").alias("policy_file"),
            F.coalesce(F.col("best.p.ignoredPaths"), F.array(*[F.lit(n) for n in V.DEFAULT_IGNORED])).alias(
                "ignored_paths"
            ),
            F.coalesce(F.col("best.p.failThreshold"), F.lit(V.DEFAULT_FAIL_THRESHOLD)).alias("fail_threshold"),
            F.col("best.p.enabledRules").alias("enabled_rules"),
            F.col("best.p.disabledRules").alias("disabled_rules"),
            F.coalesce(F.col("best.p.privacy.telemetry"), F.lit(False)).alias("telemetry"),
            F.coalesce(F.col("best.p.privacy.aiOptIn"), F.lit(False)).alias("ai_opt_in"),
        )
    )


def load_suppressions(files: DataFrame) -> DataFrame:
    """(repo_id, token): rule ids and fingerprints listed in the ignore file."""
    token = strip(F.col("text"))
    return (
        files.filter(F.col("path") == V.IGNORE_FILE)
        .select("repo_id", F.explode(split_lines(F.col("content"))).alias("text"))
        .filter((token != "") & ~token.startswith("#"))
        .select("repo_id", token.alias("token"))
        .distinct()
    )
