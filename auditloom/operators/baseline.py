"""Baselines: remember known fingerprints in versions, report only what is new."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BASELINE_SCHEMA = "repo_id string, fingerprint string, created_at timestamp"


def make_baseline(findings: DataFrame) -> DataFrame:
    """Distinct fingerprints per repository, stamped with the current time."""
    return findings.select("repo_id", "fingerprint").distinct().withColumn("created_at", F.current_timestamp())


def write_baseline(findings: DataFrame, path: str) -> str:
    """Stores the findings' fingerprints as a new version of the baseline at ``path`` and returns its name."""
    return _store(make_baseline(findings), path)


def update_baseline(findings: DataFrame, repos: DataFrame, path: str) -> str:
    """A new version in which ``repos`` (repo_id) have the fingerprints of ``findings`` and all others what they had."""
    own = make_baseline(findings.join(repos.select("repo_id").distinct(), "repo_id", "left_semi"))
    kept = read_baseline(findings.sparkSession, path)
    if kept is not None:
        own = own.unionByName(kept.join(repos.select("repo_id").distinct(), "repo_id", "left_anti"))
    return _store(own, path)


def _store(baseline: DataFrame, path: str) -> str:
    """Writes the rows beside the versions there are, and only then names them in the log; readers see a version whole or not at all."""
    version = uuid.uuid4().hex
    baseline.write.parquet(f"{path}/{version}")
    told = baseline.sparkSession.sql("SELECT 1").select(F.lit(version).alias("version"), F.current_timestamp().alias("created_at"))
    told.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def baseline_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, created_at) of the stored baselines, or None where there is none."""
    try:
        return spark.read.schema("version string, created_at timestamp").parquet(f"{path}/versions")
    except AnalysisException:
        return None


def read_baseline(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """The latest baseline at ``path``, or the given version; None, with a warning, where there is none."""
    versions = baseline_versions(spark, path)
    known = None if versions is None else versions if version is None else versions.where(F.col("version") == version)
    last = None if known is None else known.orderBy(F.desc("created_at"), "version").first()
    if last is None:
        warnings.warn(f"no baseline {version or ''} at {path}: every finding counts as new", stacklevel=2)
        return None
    return spark.read.schema(BASELINE_SCHEMA).parquet(f"{path}/{last['version']}")


def new_findings(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    if baseline is None:
        return findings
    return findings.join(baseline.select("repo_id", "fingerprint"), ["repo_id", "fingerprint"], "left_anti")


def known_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("repo_id", "fingerprint"), ["repo_id", "fingerprint"], "left_semi")


def baseline_status(unique: DataFrame, active: DataFrame, filtered: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Totals per repository.

    ``unique`` is de-duplicated, ``active`` has passed suppression and
    ``filtered`` the category and severity filters as well. The suppressed count
    is taken before those filters, the total after them. Without a baseline nothing is known.
    """
    if baseline is None:
        marked = filtered.withColumn("known", F.lit(None).cast("int"))
    else:
        known = baseline.select("repo_id", "fingerprint").distinct().withColumn("known", F.lit(1))
        marked = filtered.join(known, ["repo_id", "fingerprint"], "left")
    events = (
        unique.select("repo_id", F.lit("unique").alias("kind"))
        .unionByName(active.select("repo_id", F.lit("active").alias("kind")))
        .unionByName(
            marked.select("repo_id", F.when(F.col("known") == 1, F.lit("known")).otherwise(F.lit("new")).alias("kind"))
        )
    )

    def n(kind: str):
        return F.count_if(F.col("kind") == kind)

    return events.groupBy("repo_id").agg(
        (n("known") + n("new")).alias("total_findings"),
        n("new").alias("new_findings"),
        (n("known") + n("unique") - n("active")).alias("suppressed_findings"),
    )
