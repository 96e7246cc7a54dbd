"""Small helpers shared by the operators: non-null keys, seeded order, exact running totals."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts that split at white space only.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def non_null_key(value: Column) -> Column:
    """A string that is never null and tells null from every text; text order is kept and null comes last."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("~"))


def seeded_order(row_id: Column, seed: int) -> Column:
    """Hex digest by which rows are shuffled; the same for the same id and seed on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def digest_bucket(digest: Column, buckets: int) -> Column:
    """Equal ranges of a hex digest, in its order."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")


def bucket_count(rows: int) -> int:
    """The square root: as many buckets in a group's prefix as rows in a bucket, at any size."""
    return max(16, math.isqrt(rows))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, in the order (bucket, *order).

    ``bucket`` cuts each group into ranges of the order, so that a group of any size
    is spread over many tasks: sums per (group, bucket) are combined before their
    shuffle, their prefix is taken over a few rows per group, and only the rows of
    one bucket are ordered together. group and bucket must not be null.
    """
    keys = [*group, bucket]
    before = Window.unboundedPreceding, -1
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    prefix = Window.partitionBy(*group).orderBy(bucket).rowsBetween(*before)
    starts = sums.select(*keys, F.coalesce(F.sum("__sum").over(prefix), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    inner = F.coalesce(F.sum(value).over(within), F.lit(0))
    return df.join(starts, keys).withColumn(out, (F.col("__start") + inner).cast("long")).drop("__start")


def ship_package(spark: SparkSession) -> None:
    """Gives the package to Python workers through Spark, once per session, so that tasks import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_auditloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="auditloom-code-"), "auditloom_code")
    with zipfile.ZipFile(f"{base}.zip", "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(f"{base}.zip")
    context._auditloom_shipped = True
