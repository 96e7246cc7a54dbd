"""Source-to-sink flows inside a file: an as-of match of sinks to the latest assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.regex import has, java_pattern, strip
from auditloom.operators import fixed_values as V
from auditloom.operators.digest import split_lines, with_barrier
from auditloom.operators.roles import any_of


def flow_events(files: DataFrame) -> DataFrame:
    """Source assignments and identifiers on sink lines, as rows (repo_id, path, line, ...); contents are read once.

    A file or line is searched only where its lower-case text holds one of the words that every match has.
    """
    source_rx = java_pattern(V.SOURCE_ASSIGNMENT, True)
    text, low = F.col("text"), F.col("low")
    holds_input = any_of(*[low.contains(w) for w in V.USER_INPUT_WORDS])
    sinks = {k: any_of(*[low.contains(w) for w in V.FLOW_SINK_WORDS[k]]) & has(text, p) for k, p in V.FLOW_SINKS.items()}
    asking = with_barrier(files.filter(F.col("path").rlike(java_pattern(V.FLOW_PATH))), {"low": F.lower("content")})
    each_line = asking.filter(holds_input & has(F.col("content"), V.USER_INPUT)).select(
        "repo_id", "path", F.posexplode_outer(split_lines(F.col("content"))).alias("pos", "text")
    )
    found = {
        "assigned": F.when(holds_input, F.regexp_extract(text, source_rx, 1)).otherwise(F.lit("")),
        "kinds": F.array_compact(F.array(*[F.when(there, F.lit(k)) for k, there in sinks.items()])),
    }
    lines = with_barrier(with_barrier(each_line, {"low": F.lower(text)}), found).filter(
        (F.col("assigned") != "") | (F.size("kinds") > 0)
    )

    def event(step: int, var: Column, source_expr: Column, sink_expr: Column, kinds: Column) -> Column:
        return F.struct(
            F.lit(step).alias("step"), var.alias("var"), source_expr.alias("source_expr"),
            sink_expr.alias("sink_expr"), kinds.alias("kinds"),
        )

    no_text, no_kinds = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    source = event(0, F.col("assigned"), F.regexp_extract(text, source_rx, 2), no_text, no_kinds)
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), 1))
    used = F.transform(words, lambda w: event(1, w, no_text, strip(text), F.col("kinds")))
    events = F.array_compact(
        F.concat(
            F.array(F.when(F.col("assigned") != "", source)), F.when(F.size("kinds") > 0, used).otherwise(F.slice(used, 1, 0))
        )
    )
    rows = lines.select("repo_id", "path", (F.col("pos") + 1).alias("line"), F.explode(events).alias("e"))
    return rows.select("repo_id", "path", "line", "e.*").filter(~F.col("var").rlike("^[0-9]"))


def taint_flows(files: DataFrame) -> DataFrame:
    """One row per (sink line, sink kind, tainted variable) with its latest source.

    Sources and sink words share one window per (file, variable); the last source
    seen is carried forward, so no pairs of sources and sinks are formed. A source
    on the sink's own line counts, as it precedes it in the order.
    """
    w = (
        Window.partitionBy("repo_id", "path", "var")
        .orderBy("line", "step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    source = F.last(
        F.when(F.col("step") == 0, F.struct("source_expr", F.col("line").alias("source_line"))), ignorenulls=True
    ).over(w)
    text = F.col("sink_expr")
    dynamic = any_of(*[text.contains(m) for m in ("+", "`", "%", ".format(", 'f"')])
    return (
        flow_events(files)
        .withColumn("source", source)
        .filter((F.col("step") == 1) & F.col("source").isNotNull())
        .select("*", F.explode_outer("kinds").alias("kind"))
        .filter((F.col("kind") != "sql") | dynamic)
        .select(
            "repo_id",
            F.concat(F.lit("flow-"), F.col("kind"), F.lit("-"), F.col("path"), F.lit("-"), F.col("line")).alias("flow_id"),
            F.col("path").alias("file"),
            "kind",
            F.col("line").alias("sink_line"),
            F.col("sink_expr"),
            F.col("var").alias("variable"),
            F.col("source.source_expr").alias("source_expr"),
            F.col("source.source_line").alias("source_line"),
            F.lit("HIGH").alias("confidence"),
            F.lit(False).alias("is_sanitized"),
        )
    )
