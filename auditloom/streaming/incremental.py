"""Incremental audit of arriving files (our own extension).

File rows arrive as a stream; the same narrow rule projection runs on each micro-batch.
Which findings are already told is kept as tables on shared storage, one folder a
micro-batch, and not as state in executors' memory: rows may come late by any time and
files may come again, and still each finding is told once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditloom.operators.baseline import new_findings, read_baseline
from auditloom.operators.digest import explode_hits, rule_hits
from auditloom.operators.findings import dedup_findings, to_findings
from auditloom.sources.files import filter_ignored_paths

FILES_SCHEMA = "repo_id string, path string, length long, content string, arrived_at timestamp"
#: Micro-batches after which the fingerprints told so far are written together.
COMPACT_EVERY = 64


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(FILES_SCHEMA)
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .parquet(path)
    )


def batch_findings(arrived: DataFrame) -> DataFrame:
    """Line and file rule findings of file rows, one a fingerprint: the first by line."""
    return dedup_findings(to_findings(explode_hits(rule_hits(filter_ignored_paths(arrived)))))


def dealt(batch: DataFrame) -> DataFrame:
    """A micro-batch over all cores: it comes from few files, and a file of one row group is one task."""
    return batch.repartition(batch.sparkSession.sparkContext.defaultParallelism, "repo_id", "path")


class ToldFindings:
    """The findings told by each micro-batch, below ``path``.

    ``batch=<n>`` holds what micro-batch n told first, ``upto=<n>`` the fingerprints of all
    micro-batches up to n. Which folders micro-batch n reads hangs on n alone, and it only
    ever writes its own; so one that is run again, in part or whole, reads the same state,
    writes the same folder and tells the same rows. Micro-batch numbers are those of one
    stream: the folder belongs to its checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.every = spark, path.rstrip("/"), compact_every

    def _batch(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def _upto(self, number: int) -> str:
        return f"{self.path}/upto={number}"

    def before(self, number: int) -> DataFrame | None:
        """(repo_id, fingerprint) told by micro-batches before ``number``."""
        last = (number // self.every) * self.every - 1  # the last micro-batch of the last whole run
        paths = [self._upto(last)] if last >= 0 else []
        paths += [self._batch(n) for n in range(last + 1, number)]
        return self.spark.read.schema("repo_id string, fingerprint string").parquet(*paths) if paths else None

    def tell(self, found: DataFrame, number: int) -> DataFrame:
        """The rows of ``found`` that no earlier micro-batch told, stored and read back."""
        new_findings(found, self.before(number)).write.mode("overwrite").parquet(self._batch(number))
        told = self.spark.read.schema(found.schema).parquet(self._batch(number))
        if (number + 1) % self.every == 0:
            known = told.select("repo_id", "fingerprint")
            earlier = self.before(number)
            whole = known if earlier is None else known.unionByName(earlier)
            whole.write.mode("overwrite").parquet(self._upto(number))
        return told

    def all(self, batches: int) -> DataFrame:
        """Every finding told by the first ``batches`` micro-batches."""
        return self.spark.read.parquet(*[self._batch(n) for n in range(batches)])


def start_incremental_audit(
    arriving: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    baseline_path: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Start the query; ``sink`` receives the new findings of each micro-batch with its number.

    A micro-batch that is run again hands the same rows with the same number to ``sink``,
    so a sink that writes by the number has each finding once. Rules over whole repositories
    need all files and are left to the batch audit.
    """
    told = ToldFindings(arriving.sparkSession, f"{checkpoint.rstrip('/')}/told", compact_every)

    def write(batch: DataFrame, number: int) -> None:
        known = read_baseline(batch.sparkSession, baseline_path) if baseline_path else None
        sink(new_findings(told.tell(batch_findings(dealt(batch)), number), known), number)

    return (
        arriving.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
