"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

All documents stand end to end, by doc_id, as one sequence of their lines that hold
words, with a gap after each document. Blank lines take no place: a run goes on over
them, and one alone is no repetition. A line that occurs once ends every repeated run, so only places
of repeated lines are sorted. A place's rank is where its group begins in the suffix
order by the first h lines; groups of places that share h lines are the intervals of
the suffix array whose longest common prefix is h or more. A round orders each
group by the ranks h places on and doubles h; places that are alone, or whose run
of repeated lines is used up, have their final rank. Longest common prefixes of neighbours in the
final order come from the ranks of all rounds, largest step first. Every place of an interval
of enough lines but the earliest is a later copy, and its lines are deleted. A blank line goes
with the nearest line of words above it or, where none is above, with the first one below.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditloom.llm.common import bucket_count, running_total
from auditloom.session import materialize

#: Repeated runs of this many lines or more lose their later copies.
MIN_LINES = 1
#: Documents (narrow rows, without texts) that one task orders.
ORDERED = 50_000
#: White space as the contracts of this package have it; a line of nothing else is blank.
SPACES = " \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame, high: int) -> DataFrame:
    """A document is known by __order (its id; null behind all) and __text (a hash of its text)."""
    order = F.coalesce(F.col("doc_id"), F.lit(high + 1)).cast("long")
    return docs.select("doc_id", "text", order.alias("__order"), F.xxhash64("text").alias("__text"))


def _held_lines():
    """The lines of a text that hold words."""
    return F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def placed_documents(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, __order, __text, n_lines, n_held (lines with words) and __base (the place of the first of these) of every row, and the largest id.

    Rows are ordered by ranges that hold equally many of them, whatever their ids are.
    """
    rows, high = docs.agg(F.count("*"), F.max("doc_id")).first()
    high = high or 0
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long")
    held = F.coalesce(F.size(_held_lines()), F.lit(0)).cast("long")
    df = _keyed(docs, high).select("doc_id", "__order", "__text", lines.alias("n_lines"), F.when(lines > 0, held).otherwise(0).alias("n_held"))
    df = materialize(df.withColumn("__tie", F.monotonically_increasing_id()))
    order = ["__order", "__text", "__tie"]
    df = materialize(df.repartitionByRange(rows // ORDERED + 1, *order).withColumn("__bucket", F.spark_partition_id().cast("long")))
    df = running_total(df, [], "__bucket", order, F.col("n_held") + 1, "__base")
    return materialize(df.drop("__bucket", "__tie")), high


def line_places(docs: DataFrame, placed: DataFrame, high: int) -> DataFrame:
    """place, h1, h2 (a 128-bit line identity) of every line with words of every row. Only hashes are moved, never texts."""
    split = F.transform(_held_lines(), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    lines = _keyed(docs, high).where("text != ''").select("__order", "__text", F.posexplode(split).alias("i", "line"))
    # Rows equal in id and text are listed once and take the places of each.
    lines = lines.repartition("__order", "__text").dropDuplicates(["__order", "__text", "i"])
    own = placed.where("n_held > 0").select("__order", "__text", "__base")
    return lines.join(own, ["__order", "__text"]).select((F.col("__base") + F.col("i")).alias("place"), "line.h1", "line.h2")


def first_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """place, rank, n of the places of repeated lines, and how many lines repeat at all."""
    repeated = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    count = repeated.count()
    top = F.shiftrightunsigned(F.col("h1"), 32) * F.lit(bucket_count(count)) / F.lit(1 << 32)
    ordered = running_total(repeated.withColumn("__bucket", top.cast("long")), [], "__bucket", ["h1", "h2"], F.col("n"), "rank")
    return materialize(lines.join(ordered.select("h1", "h2", "rank", "n"), ["h1", "h2"]).select("place", "rank", "n")), count


def double(ranks: DataFrame, h: int, total: int) -> DataFrame:
    """One round: place, rank, n, used by the first 2h lines, from those by the first h.

    used tells that the run of repeated lines ends within them; such places and lone ones keep their rank.
    """
    on = ranks.select((F.col("place") - h).alias("place"), F.col("rank").alias("next"), F.col("used").alias("next_used"))
    pairs = ranks.where("n > 1 and not used").select("place", "rank").join(on, "place", "left")
    pairs = pairs.withColumn("next", F.coalesce("next", F.lit(-1))).withColumn("next_used", F.coalesce("next_used", F.lit(True)))
    groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"))
    groups = groups.withColumn("__bucket", F.expr(f"(next + 1) * {bucket_count(total)}L div {total + 1}L"))
    ordered = running_total(groups, ["rank"], "__bucket", ["next"], F.col("n"), "inside")
    new = ordered.select("rank", "next", (F.col("rank") + F.col("inside")).alias("new"), "n")
    turned = pairs.join(new, ["rank", "next"]).select("place", F.col("new").alias("rank"), "n", F.col("next_used").alias("used"))
    return turned.union(ranks.where("n = 1 or used"))


def suffix_array(lines: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Ranks by the first 1, 2, 4, ... lines (place, rank) over the places whose groups hold several; and index, place in suffix order."""
    ranks, count = first_ranks(lines)
    if not count:
        return [], None
    total = ranks.agg(F.max(F.col("rank") + F.col("n"))).first()[0]
    ranks = ranks.withColumn("used", F.lit(False))
    levels, h = [], 1
    while True:
        level = ranks.where("n > 1 and not used").select("place", "rank")
        if level.isEmpty():
            break
        levels.append(level)
        ranks = materialize(double(ranks, h, total))
        h *= 2
    # Places that share a rank stand by place, so a large group is cut by place into the ranges that its ranks span.
    last = ranks.agg(F.max("place")).first()[0]
    about = F.col("rank") + F.floor(F.col("place") / F.lit(float(last + 1)) * F.col("n")).cast("long")
    ordered = ranks.withColumn("__bucket", F.floor(about * F.lit(bucket_count(total)) / F.lit(float(total + 1))).cast("long"))
    return levels, materialize(running_total(ordered, [], "__bucket", ["rank", "place"], F.lit(1), "index").select("index", "place"))


def common_prefixes(levels: list[DataFrame], order: DataFrame) -> DataFrame:
    """index, p, q, length: the longest common prefix of each place q in suffix order with the place p before it, if any."""
    before = order.select((F.col("index") + 1).alias("index"), F.col("place").alias("p"))
    pairs = materialize(order.withColumnRenamed("place", "q").join(before, "index").withColumn("length", F.lit(0).cast("long")))
    for level in reversed(range(len(levels))):
        ranks = levels[level]
        left = ranks.select(F.col("place").alias("pl"), F.col("rank").alias("rp"))
        right = ranks.select(F.col("place").alias("ql"), F.col("rank").alias("rq"))
        ahead = pairs.withColumns({"pl": F.col("p") + F.col("length"), "ql": F.col("q") + F.col("length")})
        longer = ahead.join(left, "pl").join(right, "ql").where("rp = rq").select("index", F.lit(1 << level).alias("more"))
        pairs = pairs.join(longer, "index", "left").withColumn("length", F.col("length") + F.coalesce("more", F.lit(0))).drop("more")
        pairs = materialize(pairs)
    return pairs.where("length > 0")


def run_groups(levels: list[DataFrame], length: int) -> DataFrame | None:
    """place and group of the places whose next ``length`` lines occur elsewhere too; equal runs share a group (two ranks)."""
    level = int(math.log2(length))
    if level >= len(levels):
        return None
    h = 1 << level
    head = levels[level].select("place", F.col("rank").alias("g1"))
    if h == length:
        return head.withColumn("g2", F.lit(0).cast("long"))
    tail = levels[level].select((F.col("place") - (length - h)).alias("place"), F.col("rank").alias("g2"))
    both = head.join(tail, "place")
    several = both.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1")
    return both.join(several.select("g1", "g2"), ["g1", "g2"]).select("place", "g1", "g2")


def deleted_places(levels: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame | None:
    """place of every line in a run of ``min_lines`` or more whose like begins at an earlier place."""
    groups = run_groups(levels, min_lines)
    if groups is None:
        return None
    first = groups.groupBy("g1", "g2").agg(F.min("place").alias("first"))
    later = groups.join(first, ["g1", "g2"]).where("place > first")
    return later.select(F.explode(F.expr(f"sequence(place, place + {min_lines - 1}L)")).alias("place")).distinct()


def _by_document(places: DataFrame, placed: DataFrame, total: int) -> DataFrame:
    """Adds __base of the document that holds each place, by ranges of places and a window over few rows."""
    width = max(1024, math.isqrt(max(total, 1)))
    cut = lambda c: F.expr(f"{c} div {width}L")
    spans = placed.where("n_held > 0").select("__base", F.explode(F.sequence(cut("__base"), cut("(__base + n_held - 1)"))).alias("cut"), (F.col("__base") + F.col("n_held")).alias("__end"))
    return places.withColumn("cut", cut("place")).join(spans, "cut").where("place >= __base and place < __end").drop("cut", "__end")


def analysis(docs: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """placed_documents' columns with n_deleted and longest_run of every row; and the deleted lines (__base, line, numbered over the lines with words)."""
    spark = docs.sparkSession
    placed, high = placed_documents(docs)
    total = placed.agg(F.max(F.col("__base") + F.col("n_held"))).first()[0] or 0
    levels, order = suffix_array(materialize(line_places(docs, placed, high)))
    deleted, runs = spark.createDataFrame([], "place long"), spark.createDataFrame([], "place long, length long")
    if levels:
        prefixes = common_prefixes(levels, order)
        runs = prefixes.select(F.col("p").alias("place"), "length").union(prefixes.select("q", "length"))
        found = deleted_places(levels, min_lines)
        deleted = deleted if found is None else found
    deleted = materialize(_by_document(deleted, placed, total).select("__base", (F.col("place") - F.col("__base")).alias("line")))
    longest = _by_document(runs, placed, total).groupBy("__base").agg(F.max("length").alias("longest_run"))
    counts = deleted.groupBy("__base").agg(F.count("*").alias("n_deleted"))
    report = placed.join(counts, "__base", "left").join(longest, "__base", "left").fillna(0, ["n_deleted", "longest_run"])
    return report, deleted


@F.pandas_udf(StringType())
def _kept(texts: pd.Series, deleted: pd.Series) -> pd.Series:
    """Texts without the deleted lines (numbered over the lines with words) and the blank lines that go with them."""

    def kept(text: str, gone) -> str:
        gone, lines, number, out = set(gone), text.split("\n"), -1, []
        goes = 0 in gone
        for line in lines:
            if line.strip(SPACES):
                number += 1
                goes = number in gone
            if not goes:
                out.append(line)
        return "\n".join(out)

    return pd.Series([kept(t, g) for t, g in zip(texts, deleted)], dtype=object)


def line_deletions(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """__order, __text, __first (the earliest of the rows equal in id and text), n_rows (of these), n_lines, n_deleted, longest_run and lines (deleted, numbered from 0 over the lines with words; null: none) of each kind of row.

    Of rows equal in id and text every later one is a copy of the first as a whole, so they all lose the same lines.
    """
    report, deleted = analysis(docs, min_lines)
    lines = deleted.groupBy("__base").agg(F.collect_list("line").alias("lines"))
    equal = report.groupBy("__order", "__text").agg(F.min("__base").alias("__least"), F.count("*").alias("n_rows"))
    every = report.join(equal, ["__order", "__text"]).withColumn("__first", F.expr("__base = __least"))
    columns = ["n_rows", "n_lines", "n_deleted", "longest_run"]
    # One row stands for the later ones; only its list of lines is read.
    kinds = every.groupBy("__order", "__text", "__first").agg(F.min("__base").alias("__base"), *[F.max(c).alias(c) for c in columns])
    return kinds.join(lines, "__base", "left").drop("__base")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` as __row (all its columns), with n_lines, n_deleted (lines with words), longest_run and kept (the text that stays) of every row.

    longest_run is the longest run of lines with words, from some line of the document on, that occurs
    at another place too. Null texts stay null, empty and blank ones as they are.
    """
    kinds = materialize(line_deletions(docs, min_lines))
    high = docs.agg(F.max("doc_id")).first()[0] or 0
    order = F.coalesce(F.col("doc_id"), F.lit(high + 1)).cast("long")
    packed = docs.select(order.alias("__order"), F.xxhash64("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    # Only rows that have equals are numbered; all others are first.
    several = kinds.where("n_rows > 1").select("__order", "__text").distinct()
    own = Window.partitionBy("__order", "__text").orderBy("__text")
    numbered = packed.join(several, ["__order", "__text"], "left_semi").withColumn("__first", F.row_number().over(own) == 1)
    alone = packed.join(several, ["__order", "__text"], "left_anti").withColumn("__first", F.lit(True))
    rows = numbered.unionByName(alone).join(kinds, ["__order", "__text", "__first"])
    kept = F.when(F.col("lines").isNull(), F.col("__row.text")).otherwise(_kept(F.coalesce(F.col("__row.text"), F.lit("")), F.coalesce("lines", F.expr("array(-1L)"))))
    return rows.select("__row", "n_lines", "n_deleted", "longest_run", kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with later copies of repeated runs of ``min_lines`` lines or more taken out of ``text``; by default of any length."""
    rows = deduplicated(docs, min_lines)
    return rows.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_deleted, longest_run of every row, without a look at the texts that stay.

    Lines are separated by line feeds and compared as they are. Null and empty texts
    have no lines. n_lines counts all lines, the others those with words. longest_run is the
    longest run of lines, from some line of the document on, that occurs at another place too.
    The first occurrence, by doc_id (null last), then a hash of the text, is kept. No rows: no rows.
    """
    return analysis(docs, min_lines)[0].select("doc_id", "n_lines", "n_deleted", "longest_run")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """line_report's columns with kept_sha256, the hex SHA-256 of the text that stays (null text: null)."""
    rows = deduplicated(docs.select("doc_id", "text"), min_lines)
    return rows.select("__row.doc_id", "n_lines", "n_deleted", "longest_run", F.sha2("kept", 256).alias("kept_sha256"))
