"""Scores, readiness and gates per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import constant_map, half_up
from auditloom.operators import fixed_values as V
from auditloom.operators.rules import RULES

DIMENSIONS = ("Security", "Reliability", "Configuration", "Dependencies", "Architecture", "Production")


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(constant_map(values), key)


def deduction(severity: Column, confidence: Column) -> Column:
    weight = F.coalesce(_lookup(V.SEVERITY_WEIGHT, severity), F.lit(0))
    factor = F.coalesce(_lookup(V.CONFIDENCE_FACTOR, confidence), F.lit(1.0))
    return half_up(weight * factor)


def _dimensions() -> dict[str, Column]:
    category, severity = F.col("category"), F.col("severity")
    return {
        "Security": category.isin("Secrets", "Security", "Authentication", "Authorization", "Privacy"),
        "Reliability": (category == "Reliability")
        | ((category == "Security") & F.col("rule_id").isin("CODE-001", "CODE-006")),
        "Configuration": category == "Configuration",
        "Dependencies": category == "Dependencies",
        "Architecture": category.isin("API", "Database", "Authorization"),
        "Production": (category == "Configuration") | severity.isin("CRITICAL", "HIGH"),
    }


def contributions(findings: DataFrame) -> DataFrame:
    """(repo_id, fingerprint, rule_id, ..., dimension, points): one row per finding and dimension it lowers."""
    points = F.col("points")
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    applies,
                    F.struct(
                        F.lit(name).alias("dimension"),
                        (half_up(points * 0.75) if name == "Production" else points).alias("points"),
                    ),
                )
                for name, applies in _dimensions().items()
            ]
        )
    )
    return (
        findings.withColumn("points", deduction(F.col("severity"), F.col("confidence")))
        .filter(points > 0)
        .select(
            "repo_id",
            "fingerprint",
            "rule_id",
            "title",
            "category",
            "severity",
            "confidence",
            F.explode(entries).alias("e"),
        )
        .select("repo_id", "fingerprint", "rule_id", "title", "category", "severity", "confidence", "e.*")
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in V.SEVERITIES]
    )


def severity_share(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Rounded percentage of each severity, 0 for a repository without findings."""
    counted = repos.join(severity_counts(findings), "repo_id", "left")
    names = [f"{s.lower()}_count" for s in V.SEVERITIES]
    total = sum([F.coalesce(F.col(n), F.lit(0)) for n in names], F.lit(0))
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("severity"), F.coalesce(F.col(n), F.lit(0)).alias("n"))
            for s, n in zip(V.SEVERITIES, names)
        ]
    )
    return counted.select("repo_id", total.alias("total"), F.explode(rows).alias("r")).select(
        "repo_id",
        "r.severity",
        F.col("r.n").alias("findings"),
        F.when(F.col("total") == 0, F.lit(0)).otherwise(half_up(F.col("r.n") / F.col("total") * 100)).alias("percent"),
    )


def _totals(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One aggregation with everything the scores need; repositories without findings keep zeros."""
    points = deduction(F.col("severity"), F.col("confidence"))
    category, severity = F.col("category"), F.col("severity")
    aggregates = []
    for name, applies in _dimensions().items():
        value = half_up(points * 0.75) if name == "Production" else points
        key = name.lower()
        aggregates.append(F.sum(F.when(applies & (points > 0), value).otherwise(0)).alias(f"{key}_points"))
        aggregates.append(F.count_if(applies & (points > 0)).alias(f"{key}_items"))
    aggregates += [F.count_if(severity == s).alias(f"{s.lower()}_count") for s in V.SEVERITIES]
    high = severity.isin("CRITICAL", "HIGH")
    aggregates += [
        F.count_if(category == "Deployment").alias("deployment_findings"),
        F.count_if((category == "Deployment") & high).alias("deployment_high"),
        F.count_if(category == "Observability").alias("observability_findings"),
        F.count_if((category == "Observability") & (severity == "HIGH")).alias("observability_high"),
        F.count_if(category == "Testing").alias("testing_findings"),
        F.count_if(F.col("rule_id") == "TST-001").alias("testing_none"),
        F.max("severity_rank").alias("max_rank"),
        F.count("*").alias("findings"),
    ]
    summed = findings.groupBy("repo_id").agg(*aggregates)
    joined = repos.join(summed, "repo_id", "left")
    numeric = [c for c in summed.columns if c not in ("repo_id", "max_rank")]
    return joined.fillna(0, subset=numeric)


def _score(name: str) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.col(f"{name}_points")).cast("int").alias(f"{name}_score")


def scores(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Six dimension scores, the overall score and the readiness status, one row per repository."""
    names = [d.lower() for d in DIMENSIONS]
    scored = _totals(findings, repos).select("*", *[_score(n) for n in names])
    # terms in this order: a double sum depends on it
    overall = half_up(
        F.col("security_score") * 0.3
        + F.col("production_score") * 0.2
        + F.col("configuration_score") * 0.15
        + F.col("architecture_score") * 0.15
        + F.col("dependencies_score") * 0.1
        + F.col("reliability_score") * 0.1
    )
    scored = scored.withColumn("overall_score", overall)
    total = F.col("overall_score")
    status = (
        F.when((F.col("critical_count") > 0) | (F.col("high_count") > 2) | (total < 70), F.lit("NOT_READY"))
        .when((F.col("high_count") > 0) | (F.col("medium_count") > 3) | (total < 85), F.lit("NEEDS_ATTENTION"))
        .otherwise(F.lit("READY"))
    )
    return scored.withColumn("status", status)


def score_report(scored: DataFrame) -> DataFrame:
    return scored.select(
        "repo_id",
        *[f"{d.lower()}_score" for d in DIMENSIONS],
        "overall_score",
        "status",
        *[f"{s.lower()}_count" for s in V.SEVERITIES],
    )


def readiness(scored: DataFrame) -> DataFrame:
    """Seven labels per repository."""

    def label(name: str, good: str, middle: str, low: str, limit: int) -> Column:
        value = F.col(f"{name}_score")
        return F.when(value >= 90, good).when(value >= limit, middle).otherwise(low).alias(name)

    def existence(name: str, worst: Column, word: str) -> Column:
        return (
            F.when(worst > 0, word).when(F.col(f"{name}_findings") > 0, "LIMITED").otherwise("GOOD").alias(name)
        )

    return scored.select(
        "repo_id",
        label("security", "READY", "NEEDS_ATTENTION", "NOT_READY", 70),
        label("reliability", "GOOD", "NEEDS_ATTENTION", "LIMITED", 75),
        label("configuration", "GOOD", "NEEDS_ATTENTION", "INSECURE", 75),
        label("dependencies", "GOOD", "REVIEW", "OUTDATED", 75),
        existence("deployment", F.col("deployment_high"), "RISKY"),
        existence("observability", F.col("observability_high"), "MISSING"),
        existence("testing", F.col("testing_none"), "NONE"),
    )


def category_scores(scored: DataFrame) -> DataFrame:
    """(repo_id, category, score, findings_count), five rows per repository."""
    listed = (
        ("Secrets", "security"),
        ("Reliability", "reliability"),
        ("Configuration", "configuration"),
        ("Dependencies", "dependencies"),
        ("Production", "production"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("category"),
                F.col(f"{n}_score").alias("score"),
                F.col(f"{n}_items").alias("findings_count"),
            )
            for label, n in listed
        ]
    )
    return scored.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


def gate(findings: DataFrame, repos: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """(repo_id, fail_threshold, exit_code): 0 clean, 1 below the threshold, 2 at or above it."""
    worst = findings.groupBy("repo_id").agg(F.max("severity_rank").alias("max_rank"))
    joined = repos.join(worst, "repo_id", "left")
    default = F.lit(V.DEFAULT_FAIL_THRESHOLD)
    if policies is None:
        joined = joined.withColumn("fail_threshold", default)
    else:
        joined = joined.join(policies.select("repo_id", "fail_threshold"), "repo_id", "left").withColumn(
            "fail_threshold", F.coalesce(F.col("fail_threshold"), default)
        )
    limit = _lookup(V.SEVERITY_RANK, F.col("fail_threshold"))
    code = F.when(F.col("max_rank").isNull(), 0).when(F.col("max_rank") >= limit, 2).otherwise(1)
    return joined.select("repo_id", "fail_threshold", code.alias("exit_code"))


def analyzer_status(raw_findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings per analyzer before de-duplication, zeros included."""
    names = list(dict.fromkeys(r.analyzer for r in RULES if r.family != "corr"))
    counted = raw_findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("analyzer") == n).alias(n) for n in names]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("analyzer"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("findings_count"))
            for n in names
        ]
    )
    return (
        repos.join(counted, "repo_id", "left")
        .select("repo_id", F.explode(rows).alias("r"))
        .select("repo_id", "r.analyzer", F.lit("completed").alias("status"), "r.findings_count")
    )


