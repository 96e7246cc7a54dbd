"""Suppressions: ignore lists and inline markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import fixed_values as V
from auditloom.operators.digest import split_lines, with_barrier
from auditloom.sources.files import small_side


def file_markers(files: DataFrame) -> DataFrame:
    """(repo_id, path, marker): lines that switch rules off for their whole file."""
    lines = F.filter(split_lines(F.col("content")), lambda x: x.contains(V.FILE_MARKER))
    return files.filter(F.col("content").contains(V.FILE_MARKER)).select(
        "repo_id", "path", F.explode_outer(lines).alias("marker")
    )


def line_markers(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, marker): for every line a marker reaches, that line and the one before.

    A marker reaches its own line and the next. The rule id may stand on either
    line of the pair, so the pair's text is kept.
    """
    marked = with_barrier(
        files.filter(F.col("content").contains(V.LINE_MARKER)), {"lines": split_lines(F.col("content"))}
    )
    lines = F.col("lines")
    hits = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].contains(V.LINE_MARKER)
    )

    def reach(s):
        i = s["i"]
        before = F.when(i > 0, F.get(lines, i - 1)).otherwise(F.lit(""))
        after = F.coalesce(F.get(lines, i + 1), F.lit(""))
        return F.array(
            F.struct((i + 1).alias("line"), F.concat_ws("\n", before, s["x"]).alias("marker")),
            F.struct((i + 2).alias("line"), F.concat_ws("\n", s["x"], after).alias("marker")),
        )

    return marked.select("repo_id", "path", F.explode_outer(F.flatten(F.transform(hits, reach))).alias("m")).select(
        "repo_id", "path", "m.line", "m.marker"
    )


def listed(findings: DataFrame, tokens: DataFrame, how: str) -> DataFrame:
    by_rule = small_side(tokens.withColumnRenamed("token", "rule_id"))
    return findings.join(by_rule, ["repo_id", "rule_id"], how)


def suppress_by_list(findings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Drop findings whose rule id or fingerprint is listed for their repository."""
    kept = listed(findings, tokens, "left_anti")
    return kept.join(tokens.withColumnRenamed("token", "fingerprint"), ["repo_id", "fingerprint"], "left_anti")


def suppress_inline(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Drop findings switched off by a marker in their own file."""
    by_file = file_markers(files).withColumnRenamed("path", "m_path").withColumnRenamed("repo_id", "m_repo")
    by_line = (
        line_markers(files)
        .withColumnRenamed("path", "m_path")
        .withColumnRenamed("repo_id", "m_repo")
        .withColumnRenamed("line", "m_line")
    )
    same_file = (F.col("repo_id") == F.col("m_repo")) & (F.col("file") == F.col("m_path"))
    names_rule = F.col("marker").contains(F.col("rule_id"))
    kept = findings.join(by_file, same_file & names_rule, "left_anti")
    return kept.join(by_line, same_file & (F.col("line") == F.col("m_line")) & names_rule, "left_anti")


def suppress(findings: DataFrame, files: DataFrame, tokens: DataFrame) -> DataFrame:
    return suppress_inline(suppress_by_list(findings, tokens), files)
