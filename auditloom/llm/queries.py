"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import (
    compact_windows,
    ctw,
    decontaminate,
    fill_middle,
    forest,
    line_dedup,
    mixing,
    nbsvm,
    partenum,
    piece_codec,
    prefix_trie,
    shard,
    token_counts,
)
from auditloom.llm.common import ship_package, table
from auditloom.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @functools.wraps(fn)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = shipped
    return shipped


@query
def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query
def op2_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return shard.interleave(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op3_forest(spark, sf_dir):
    return forest.nearest(table(spark, sf_dir, "embeddings"))


@query
def op4_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_partenum(spark, sf_dir):
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_ctw(spark, sf_dir):
    return ctw.scores(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = nbsvm.score(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", nbsvm.held_out().alias("held_out"), "score", "predicted")


@query
def op10_passages(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op12_piece_codec(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op13_fill_middle(spark, sf_dir):
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
