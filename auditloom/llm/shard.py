"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded digest and ranked; the fractional
rank (rank + 1/2) / rows of the source places each source evenly over [0, 1); all
rows are sorted by it and cut into equal counts. Every prefix, and so every
shard, then holds each source in its share of the whole, within a row or so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import bucket_count, digest_bucket, non_null_key, running_total, seeded_order

SHARDS = 40
SEED = 17


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source") -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to every row of ``docs``.

    The law is ``rows``: shard sizes are at most one row apart, slots count from 0
    without gaps. Null text: size 16, crc 0. Null source is a source of its own,
    null doc_id an id of its own. Rows of one id keep the order of text_crc32 and
    size; rows equal in all of these are interchangeable. No rows: no rows.
    Columns of ``docs`` with the added names are replaced.
    """
    rows = docs.count()
    buckets = bucket_count(rows)
    df = docs.withColumns(
        {
            "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16,
            "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long"),
            "__source": non_null_key(F.col(source)),
            "__digest": seeded_order(F.col("doc_id"), seed),
        }
    ).withColumn("__bucket", digest_bucket(F.col("__digest"), buckets))
    order = ["__digest", "doc_id", "text_crc32", "size"]
    df = running_total(df, ["__source"], "__bucket", order, F.lit(1), "__rank")
    counts = docs.groupBy(non_null_key(F.col(source)).alias("__source")).agg(F.count("*").alias("__rows"))
    df = df.join(counts, "__source").withColumn("__fraction", (F.col("__rank") + 0.5) / F.col("__rows"))
    df = df.withColumn("__bucket", F.floor(F.col("__fraction") * buckets).cast("long"))
    df = running_total(df, [], "__bucket", ["__fraction", "__source", "__rank"], F.lit(1), "__place")
    whole = f"{max(rows, 1)}L"
    return df.withColumns(
        {
            "law": F.lit("rows"),
            "shard": F.expr(f"cast(__place * {shards}L div {whole} as int)"),
            "slot": F.expr(f"__place - ((__place * {shards}L div {whole}) * {whole} + {shards - 1}L) div {shards}L"),
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop("__source", "__digest", "__bucket", "__rank", "__rows", "__fraction", "__place")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of files per shard, rows in slot order; a shard is spread over tasks by slot range."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
