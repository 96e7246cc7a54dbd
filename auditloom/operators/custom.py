"""User-defined analyzers: whole frames of findings, isolated from one another and from the audit."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from uuid import uuid4

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.operators.findings import FINDING_COLUMNS
from auditloom.session import materialize

Analyzer = Callable[[DataFrame], DataFrame]
STATUS = "analyzer string, status string, findings_count long, error string"
#: Analyzers whose jobs run side by side.
AT_ONCE = 4


def run_custom(files: DataFrame, analyzers: Mapping[str, Analyzer], timeout: float | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Run each analyzer on ``files``; a failing one yields a ``failed`` status and no findings.

    Each result is written on its own, because a fault inside a lazy frame would
    otherwise surface later and take the other analyzers down with it. Their jobs run side by
    side under a tag each; one that takes more than ``timeout`` seconds has its jobs
    cancelled and counts as failed. Rows are counted while they are written.
    """
    spark = files.sparkSession
    run = uuid4().hex

    def work(number: int, name: str, analyze: Analyzer) -> tuple[DataFrame, int]:
        spark.addTag(f"auditloom-{run}-{number}")
        try:
            counted = Observation()
            found = analyze(files).select(*FINDING_COLUMNS).withColumn("analyzer", F.lit(name))
            stored = materialize(found.observe(counted, F.count(F.lit(1)).alias("n")))
            return stored, counted.get["n"]
        finally:
            spark.clearTags()

    found: DataFrame | None = None
    statuses = []
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = [(n, name, pool.submit(work, n, name, a)) for n, (name, a) in enumerate(analyzers.items())]
        for number, name, job in running:
            try:
                rows, count = job.result(timeout)
            except Late:
                spark.interruptTag(f"auditloom-{run}-{number}")
                statuses.append((name, "failed", 0, f"stopped after {timeout} seconds"))
            except Exception as error:  # the isolation is the point here
                statuses.append((name, "failed", 0, str(error)))
            else:
                statuses.append((name, "completed", count, None))
                found = rows if found is None else found.unionByName(rows)
    return found, spark.createDataFrame(statuses, STATUS)


def custom_status(found: DataFrame | None, status: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, analyzer, status, findings_count) of each custom analyzer in each repository; a failed one has no findings."""
    names = [(r.analyzer, r.status) for r in status.collect()]
    rows = F.array(*[F.struct(F.lit(n).alias("analyzer"), F.lit(s).alias("status")) for n, s in names])
    every = repos.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")
    if found is None:
        return every.withColumn("findings_count", F.lit(0).cast("long"))
    counted = found.groupBy("repo_id", "analyzer").agg(F.count("*").alias("n"))
    counts = every.join(counted, ["repo_id", "analyzer"], "left").withColumn("findings_count", F.coalesce("n", F.lit(0)))
    return counts.select("repo_id", "analyzer", "status", "findings_count")
