"""Environment variables: documented, referenced and active names per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.regex import strip
from auditloom.operators import fixed_values as V
from auditloom.operators.digest import split_lines
from auditloom.operators.roles import guarded
from auditloom.operators.rules import ordinals
from auditloom.sources.files import small_side


def documented_names() -> Column:
    """Names declared in an ``.env.example``."""
    stripped = F.transform(split_lines(F.col("content")), strip)
    kept = F.filter(stripped, lambda t: (t != "") & ~t.startswith("#"))
    names = F.transform(kept, lambda t: strip(F.substring_index(t, "=", 1)))
    return F.when(F.col("path") == ".env.example", F.array_distinct(names))


def referenced_names(low: Column | None = None) -> Column:
    """``process.env`` names in a file that is neither a test nor an env file; ``low`` as in :func:`file_flags`."""
    path, content = F.col("path"), F.col("content")
    known = F.array(*[F.lit(n) for n in V.WELL_KNOWN_ENV])
    found = F.array_except(F.regexp_extract_all(content, F.lit(V.ENV_REFERENCE), 1), known)
    named = guarded(content.contains("process.env."), V.ENV_WORDS, low)
    return F.when(~path.contains("test") & ~path.contains(".env") & named, found)


def env_rows(files: DataFrame) -> DataFrame:
    """(repo_id, documented, referenced): the names found in each file, in one scan."""
    return files.select("repo_id", documented_names().alias("documented"), referenced_names().alias("referenced"))


def env_names(rows: DataFrame) -> DataFrame:
    """(repo_id, name, documented, referenced): one row per name."""

    def tagged(column: str, documented: bool) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.expr("cast(array() as array<string>)")),
            lambda n: F.struct(n.alias("name"), F.lit(documented).alias("doc")),
        )

    return (
        rows.filter(F.col("documented").isNotNull() | F.col("referenced").isNotNull())
        .select("repo_id", F.explode_outer(F.concat(tagged("documented", True), tagged("referenced", False))).alias("n"))
        .filter(F.col("n").isNotNull())
        .groupBy("repo_id", "n.name")
        .agg(F.bool_or("n.doc").alias("documented"), F.bool_or(~F.col("n.doc")).alias("referenced"))
    )


def env_references(files: DataFrame) -> DataFrame:
    return env_names(env_rows(files)).filter("referenced").select("repo_id", "name")


def undocumented_env(names: DataFrame, files: DataFrame) -> DataFrame:
    """Names used in code but absent from ``.env.example``, where that file exists.

    ``names`` comes from :func:`env_names`; of ``files`` only paths are read.
    """
    documents = files.filter(F.col("path") == ".env.example").select("repo_id")
    return (
        names.filter(F.col("referenced") & ~F.col("documented"))
        .select("repo_id", "name")
        .join(small_side(documents), "repo_id", "left_semi")
    )


def active_env(files: DataFrame) -> DataFrame:
    """(repo_id, path, content) of the first of ``.env`` and ``.env.local``."""
    return (
        files.filter(F.col("path").isin(*V.ROOT_ENV_FILES))
        .groupBy("repo_id")
        .agg(F.min_by(F.struct("path", "content"), "path").alias("f"))
        .select("repo_id", "f.path", "f.content")
    )


def missing_env(names: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, name): documented names the active file does not assign."""
    active = active_env(files)
    assigned = F.col("content").contains(F.concat(F.col("name"), F.lit("=")))
    return (
        names.filter("documented")
        .select("repo_id", "name")
        .join(active, "repo_id")
        .filter(~assigned)
        .select("repo_id", "path", "name")
    )


def first_names(names: DataFrame, count: int = 3) -> DataFrame:
    """(repo_id, first): the first names in order; each task keeps only ``count`` before the shuffle."""
    w = Window.partitionBy("repo_id").orderBy("name")
    return (
        names.withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= count)
        .groupBy("repo_id")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("first"))
    )


def set_identity(names: DataFrame) -> DataFrame:
    """(repo_id, n, identity): how many names a repository has, and a digest that tells their set.

    A hash tree of two levels: names fall into 4,096 ranges of their SHA-256, each range's
    digests are hashed in order, then the ranges. Sets are equal where identities are, to
    the strength of SHA-256, and no task holds more than a range of one repository.
    """
    digest = F.sha2("name", 256)

    def rolled(parts: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ""), 256)

    ranges = (
        names.select("repo_id", digest.alias("d"))
        .distinct()
        .groupBy("repo_id", F.substring("d", 1, 3).alias("range"))
        .agg(F.count("*").alias("n"), rolled(F.col("d")).alias("rolled"))
    )
    return ranges.groupBy("repo_id").agg(F.sum("n").alias("n"), rolled(F.concat("range", "rolled")).alias("identity"))


def env_evidence(names: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, rule_id, file, name): every name that CONFIG-005 and CONFIG-007 stand on, a row each."""
    undocumented = undocumented_env(names, files).select("repo_id", F.lit(".env.example").alias("path"), "name")
    listed = missing_env(names, files).select("repo_id", F.lit("CONFIG-005").alias("rule_id"), F.col("path").alias("file"), "name")
    return listed.unionByName(undocumented.select("repo_id", F.lit("CONFIG-007").alias("rule_id"), F.col("path").alias("file"), "name"))


def env_hits(names: DataFrame, files: DataFrame) -> DataFrame:
    """One hit per repository and rule; the text shows the first three names, :func:`env_evidence` has all."""
    labels = {"CONFIG-005": "Missing variables", "CONFIG-007": "Undocumented variables"}
    listed = env_evidence(names, files)
    hits = []
    for rule_id, label in labels.items():
        own = listed.filter(F.col("rule_id") == rule_id)
        shown = first_names(own.select("repo_id", "name"))
        where = own.groupBy("repo_id").agg(F.min("file").alias("path"))
        text = F.concat(F.lit(label + ": "), F.col("first"), F.lit(" ("), F.col("n").cast("string"), F.lit(" in all)"))
        joined = set_identity(own).join(shown, "repo_id").join(where, "repo_id")
        hits.append(
            joined.select(
                "repo_id", "path", F.lit(1).alias("line"), text.alias("text"),
                F.lit(ordinals(rule_id)[0]).alias("ord"), F.col("identity").alias("fp_text"),
            )
        )
    return hits[0].unionByName(hits[1])
