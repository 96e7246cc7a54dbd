"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

Each source is a stream of its shuffled documents, cut into blocks of equal word
count. Slot i of the schedule is the golden-ratio point frac(i * phi); mapped
through the cumulative block counts that the sources need, it names a source. The
slots of a source are ranked, and rank k takes the source's block k modulo its
number of blocks. A source's slots end where its target is reached, so the words
taken equal the target rounded down, and any stretch of the schedule holds the
sources in their proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import SPACED_WORD, bucket_count, digest_bucket, non_null_key, running_total, seeded_order

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BLOCK_WORDS = 4096
SEED = 29
GOLDEN = 0.6180339887498949
#: Golden-ratio points leave no gap of 2 / n, so this many times the needed slots reach every source's need.
SLOT_FACTOR = 3


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: __source, source_size, target (water filling below MOST times the size), __goal.

    Sources in code-point order, null last, weigh WEIGHTS in turn. Sorted by cap over
    weight, a source is capped when its share of what the earlier ones leave exceeds
    its cap; those behind the first uncapped one are uncapped too.
    """
    whole = Window.partitionBy()
    by_name = whole.orderBy("__source")
    by_ratio = whole.orderBy(F.col("__cap") / F.col("__w"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    s = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("__w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("__cap", F.col("source_size") * MOST).withColumns(
        {
            "__budget": F.sum("source_size").over(whole) * F.lit(BUDGET),
            "__all_w": F.sum("__w").over(whole),
            "__caps_before": F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0)),
            "__w_before": F.coalesce(F.sum("__w").over(by_ratio), F.lit(0)),
        }
    )
    left = (F.col("__budget") - F.col("__caps_before")) / (F.col("__all_w") - F.col("__w_before"))
    s = s.withColumn("__capped", F.col("__w") * left > F.col("__cap"))
    capped = F.col("__capped")
    s = s.withColumns(
        {
            "__capped_sum": F.coalesce(F.sum(F.when(capped, F.col("__cap"))).over(whole), F.lit(0)),
            "__capped_w": F.coalesce(F.sum(F.when(capped, F.col("__w"))).over(whole), F.lit(0)),
        }
    )
    free = F.col("__w") * (F.col("__budget") - F.col("__capped_sum")) / (F.col("__all_w") - F.col("__capped_w"))
    s = s.withColumn("target", F.when(capped, F.col("__cap").cast("double")).otherwise(free))
    return s.select("__source", "source_size", "target", F.floor("target").cast("long").alias("__goal"))


def schedule(spark, goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The used slots: slot, __source, __rank, __block, __epoch, __take (words taken of the block)."""
    b = f"{block_words}L"
    need = goals.where("source_size > 0 and __goal > 0").withColumn("__blocks", F.expr(f"(source_size + {b} - 1) div {b}"))
    need = need.withColumn(
        "__need", F.expr(f"(__goal div source_size) * __blocks + (__goal % source_size + {b} - 1) div {b}")
    )
    upto = Window.orderBy("__source").rowsBetween(Window.unboundedPreceding, 0)
    need = need.withColumn("__high", F.sum("__need").over(upto)).withColumn("__low", F.col("__high") - F.col("__need"))
    sources, total = need.agg(F.count("*"), F.coalesce(F.sum("__need"), F.lit(0))).first()
    slots = spark.range(0, SLOT_FACTOR * total).withColumnRenamed("id", "slot")
    point = F.col("slot") * F.lit(GOLDEN)
    slots = slots.withColumn("__at", (point - F.floor(point)) * F.lit(float(total)))
    cells = max(1024, 4 * sources)
    cell = lambda c: F.floor(c * F.lit(cells) / F.lit(float(max(total, 1)))).cast("long")
    ranges = need.withColumn("__cell", F.explode(F.sequence(cell(F.col("__low")), cell(F.col("__high")))))
    slots = slots.withColumn("__cell", cell(F.col("__at"))).join(ranges, "__cell")
    slots = slots.where("__at >= __low and __at < __high")
    slots = slots.withColumn("__part", F.expr(f"slot div {max(1024, SLOT_FACTOR * total // 1024)}L"))
    slots = running_total(slots, ["__source"], "__part", ["slot"], F.lit(1), "__rank").where("__rank < __need")
    slots = slots.withColumns({"__epoch": F.expr("__rank div __blocks"), "__block": F.expr("__rank % __blocks")})
    take = F.expr(
        f"least({b}, source_size - __block * {b}, __goal - __epoch * source_size - __block * {b})"
    )
    return slots.select("slot", "__source", "__rank", "__block", "__epoch", take.alias("__take"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, source: str = "source") -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes) to every row of ``docs``.

    A document is taken at most MOST times; null, empty or blank texts have size 0 and
    are never taken. Null source is a source of its own, null doc_id an id of its own;
    rows equal in id and size stand in any order, which changes no word count. No
    rows or no words: no slots, targets 0. Columns of ``docs`` with the added names are replaced.
    """
    spark, b = docs.sparkSession, f"{block_words}L"
    df = docs.withColumns(
        {
            "size": word_count(F.col("text")),
            "__source": non_null_key(F.col(source)),
            "__digest": seeded_order(F.col("doc_id"), seed),
        }
    ).withColumn("__bucket", digest_bucket(F.col("__digest"), bucket_count(docs.count())))
    goals = targets(df.select("__source", "size"))
    df = df.drop("source_size", "target", "taken")
    placed = running_total(df, ["__source"], "__bucket", ["__digest", "doc_id", "size"], F.col("size"), "__at")
    pieces = placed.where("size > 0").select(
        "__source", "__at", "size", F.explode(F.expr(f"sequence(__at div {b}, (__at + size - 1) div {b})")).alias("__block")
    )
    slots = schedule(spark, goals, block_words)
    takes = slots.groupBy("__source", "__block").agg(
        *[F.max(F.when(F.col("__epoch") == e, F.col("__take"))).alias(f"__take{e}") for e in range(MOST)]
    )
    low = F.expr(f"greatest(__at - __block * {b}, 0L)")
    high = F.expr(f"least(__at + size - __block * {b}, {b})")
    # A block that an epoch does not take has no take; least() would pass over the null.
    take = lambda e: F.coalesce(f"__take{e}", F.lit(0))
    part = sum((F.least(high, take(e)) - F.least(low, take(e)) for e in range(MOST)), F.lit(0))
    taken = pieces.join(takes, ["__source", "__block"]).groupBy("__source", "__at", "size").agg(F.sum(part).alias("taken"))
    mixed = placed.join(taken, ["__source", "__at", "size"], "left").join(goals, "__source")
    return mixed.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop(
        "__source", "__digest", "__bucket", "__at", "__goal"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents, in the columns of ``docs``: each as often as its taken words, rounded, hold it.

    Columns of any name keep their values; documents without words are not in the mix.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    mixed = mix(packed, **options)
    copies = F.expr("if(size > 0, cast(round(taken / size) as int), 0)")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select("__row.*")
