"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", app: str = "auditloom", shuffle_partitions: int = 8) -> SparkSession:
    """A session with AQE, UTC and Arrow on; a cluster submit overrides the rest."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AUDITLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a fresh temporary one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return tempfile.mkdtemp(prefix="auditloom-")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The table lives in shared storage, so losing an executor costs a re-read and
    not a second scan of the sources; being columnar, later steps read only the
    columns they use.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/auditloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a scan that one task audits; a larger table gets more tasks, not longer ones.
TASK_ROWS = 8000


def spread(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Redistribute when the scan yields fewer partitions than cores, or than one for ``task_rows`` rows.

    Splits follow the bytes of files, and a row group is never split, so the tasks of a scan
    grow with the table until they hold 128 MB; patterns over that much text take minutes. A
    scan in small splits passes through untouched. Call it on a plain scan, before any
    shuffle; the rows are counted from the files' own counts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // task_rows))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
