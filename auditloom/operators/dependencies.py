"""Dependency inventory from root manifests and lockfiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.regex import java_pattern, strip
from auditloom.functions.text import constant_map
from auditloom.operators import fixed_values as V
from auditloom.operators.digest import split_lines
from auditloom.operators.rules import ordinals

PACKAGE_SCHEMA = "dependencies map<string,string>, devDependencies map<string,string>, _bad string"
LOCK_SCHEMA = (
    "packages map<string,struct<name:string,version:string>>, dependencies map<string,struct<version:string>>, _bad string"
)


def _parse(schema: str) -> Column:
    parsed = F.from_json(F.col("content"), schema, {"columnNameOfCorruptRecord": "_bad"})
    return F.when(parsed["_bad"].isNull(), parsed)


def package_deps() -> Column:
    """Map of a ``package.json``: a dev entry wins over a plain one of the same name; NULL if unreadable."""
    empty = F.expr("cast(map() as map<string,string>)")
    parsed = _parse(PACKAGE_SCHEMA)
    plain = F.coalesce(parsed["dependencies"], empty)
    dev = F.coalesce(parsed["devDependencies"], empty)
    merged = F.map_concat(F.map_filter(plain, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    return F.when(parsed.isNotNull(), merged)


def _entry(name: Column, version: Column, order: int, source: str) -> Column:
    return F.struct(
        name.alias("name"), version.alias("version"), F.lit(order).alias("o"), F.lit(source).alias("source_file")
    )


def _lock_entries() -> Column:
    """``package-lock.json``: the newer layout, else the older one."""
    parsed = _parse(LOCK_SCHEMA)
    newer = F.transform(
        F.filter(F.map_entries(parsed["packages"]), lambda e: e["key"] != ""),
        lambda e: _entry(
            F.when(F.coalesce(e["value"]["name"], F.lit("")) != "", e["value"]["name"]).otherwise(
                F.regexp_replace(e["key"], "^node_modules/", "")
            ),
            e["value"]["version"],
            2,
            "package-lock.json",
        ),
    )
    older = F.transform(
        F.map_entries(parsed["dependencies"]),
        lambda e: _entry(e["key"], e["value"]["version"], 2, "package-lock.json"),
    )
    return F.when(parsed["packages"].isNotNull(), newer).otherwise(older)


def _requirement_entries() -> Column:
    rx = java_pattern(V.REQUIREMENT_LINE)
    stripped = F.transform(split_lines(F.col("content")), strip)
    kept = F.filter(stripped, lambda t: (t != "") & ~t.startswith("#") & t.rlike(rx))
    return F.transform(
        kept,
        lambda t: _entry(
            F.regexp_extract(t, rx, 1), F.nullif(strip(F.regexp_extract(t, rx, 3)), F.lit("")), 3, "requirements.txt"
        ),
    )


def declared(files: DataFrame) -> DataFrame:
    """(repo_id, name, version, o, source_file): every entry of the three root files, in one scan."""
    package = F.transform(
        F.map_entries(package_deps()), lambda e: _entry(e["key"], e["value"], 1, "package.json")
    )
    path = F.col("path")
    entries = (
        F.when(path == "package.json", package)
        .when(path == "package-lock.json", _lock_entries())
        .when(path == "requirements.txt", _requirement_entries())
    )
    return (
        files.filter(path.isin("package.json", "package-lock.json", "requirements.txt"))
        .select("repo_id", F.explode_outer(entries).alias("d"))
        .filter(F.col("d").isNotNull())
        .select("repo_id", "d.*")
    )


def lock_dependencies(files: DataFrame) -> DataFrame:
    return declared(files).filter(F.col("o") == 2).select("repo_id", "name", "version")


def dependencies(files: DataFrame) -> DataFrame:
    """(repo_id, name, version, type, source_file), distinct on (name, version, type), first source wins.

    A lockfile entry is direct iff the manifest names it; both that test and the
    distinct step share one shuffle on (repo_id, name).
    """
    per_name = Window.partitionBy("repo_id", "name")
    named = F.max((F.col("o") == 1).cast("int")).over(per_name) == 1
    return (
        declared(files)
        .withColumns(
            {
                "type": F.when((F.col("o") != 2) | named, F.lit("direct")).otherwise(F.lit("transitive")),
                "v": F.coalesce(F.col("version"), F.lit("")),
            }
        )
        .groupBy("repo_id", "name", "v", "type")
        .agg(F.min(F.struct("o", "source_file")).alias("s"))
        .select(
            "repo_id",
            "name",
            F.when(F.col("v") != "", F.col("v")).alias("version"),
            "type",
            F.col("s.source_file").alias("source_file"),
        )
    )


def dependency_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("repo_id").agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("type") == "direct").alias("direct_count"),
        F.count_if(F.col("type") == "transitive").alias("transitive_count"),
    )


def deny_listed(inventory: DataFrame) -> DataFrame:
    """Inventory rows on the fixed two-row deny list, ignoring case."""
    reasons = constant_map(V.DENY_LIST)
    return inventory.filter(F.lower("name").isin(*V.DENY_LIST)).withColumn(
        "reason", F.try_element_at(reasons, F.lower("name"))
    )


def advisory_match(inventory: DataFrame, advisories: DataFrame | None) -> DataFrame:
    """Inventory with matching advisories of (name, version); without a table nothing is known."""
    if advisories is None:
        return inventory.select(
            "*", F.lit(None).cast("string").alias("advisory"), F.lit("NOT_CONFIGURED").alias("advisory_status")
        )
    return inventory.join(advisories, ["name", "version"], "left").withColumn("advisory_status", F.lit("CONFIGURED"))


def dependency_hits(inventory: DataFrame) -> DataFrame:
    version = F.col("version")
    checks = [
        ("PKG-002", F.lower("name").isin(*V.DENY_LIST)),
        ("PKG-011", version.isin("*", "latest")),
        ("PKG-012", version.startswith("file:") | version.startswith("git+") | version.startswith("http")),
    ]
    fired = F.array_compact(F.array(*[F.when(c, F.lit(ordinals(r)[0])) for r, c in checks]))
    return inventory.select(
        "repo_id",
        F.col("source_file").alias("path"),
        F.lit(1).alias("line"),
        F.concat(F.col("name"), F.lit(": "), F.coalesce(version, F.lit("unpinned"))).alias("text"),
        F.explode_outer(fired).alias("ord"),
        F.col("name").alias("fp_text"),
    ).filter(F.col("ord").isNotNull())
