"""The application graph as node and edge tables, and route-to-finding correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.regex import has, java_pattern
from auditloom.operators import fixed_values as V
from auditloom.operators.roles import basename, guarded
from auditloom.operators.rules import ordinals
from auditloom.session import materialize


def module_facts(low: Column | None = None) -> dict[str, Column]:
    """What the graph needs to know of a file's path and content; ``low`` as in :func:`file_flags`."""
    return {
        "is_module": F.col("path").rlike(java_pattern(V.MODULE_PATH)),
        "db": guarded(has(F.col("content"), V.GRAPH_DB), V.GRAPH_DB_WORDS, low),
        "net": guarded(has(F.col("content"), V.GRAPH_NETWORK), V.GRAPH_NETWORK_WORDS, low),
    }


def _module_facts(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", *[c.alias(n) for n, c in module_facts().items()])


def _node(node_id: Column, kind: str, name: Column, line: Column | None = None) -> Column:
    return F.struct(
        node_id.alias("node_id"),
        F.lit(kind).alias("node_type"),
        name.alias("name"),
        (F.lit(None).cast("int") if line is None else line).alias("line"),
    )


def _tagged(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag + ":"), value)


def graph_nodes(files: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo_id, node_id, node_type, name, file, line); the last node of an id wins."""
    path, base = F.col("path"), basename(F.col("path"))
    module = F.col("is_module")
    of_file = F.array_compact(
        F.array(
            _node(_tagged("file", path), "file", base),
            F.when(module, _node(_tagged("mod", path), "module", path)),
            F.when(
                module & F.col("db"),
                _node(_tagged("db", path), "db_op", F.concat(F.lit("database use ("), base, F.lit(")"))),
            ),
            F.when(
                module & F.col("net"),
                _node(_tagged("net", path), "network_op", F.concat(F.lit("network use ("), base, F.lit(")"))),
            ),
        )
    )
    from_files = _module_facts(files).select("repo_id", F.col("path").alias("file"), F.explode_outer(of_file).alias("n"))
    route = _node(_tagged("route", F.col("route_id")), "route", F.col("route_id"), F.col("line"))
    inputs = F.transform(
        "inputs",
        lambda i: _node(
            F.concat(F.lit("input:"), F.col("route_id"), F.lit(":"), i["name"]),
            "input",
            F.concat(i["name"], F.lit(" ("), i["source"], F.lit(")")),
            F.col("line"),
        ),
    )
    from_routes = routes.select("repo_id", "file", F.explode_outer(F.concat(F.array(route), inputs)).alias("n"))
    # file-level ids hold the path and are unique already; only route ids can repeat
    last = (
        from_routes.select("repo_id", "file", "n.*")
        .groupBy("repo_id", "node_id", "node_type")
        .agg(
            F.max_by(
                F.struct("name", "file", "line"),
                F.struct(F.col("file").alias("f"), F.coalesce(F.col("line"), F.lit(0)).alias("l")),
            ).alias("n")
        )
        .select("repo_id", "node_id", "node_type", "n.name", "n.file", "n.line")
    )
    return from_files.select("repo_id", "n.node_id", "n.node_type", "n.name", "file", "n.line").unionByName(last)


def graph_edges(files: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo_id, source_id, target_id, relationship)."""
    path = F.col("path")

    def edge(source: Column, target: Column, relationship: str) -> Column:
        return F.struct(source.alias("source_id"), target.alias("target_id"), F.lit(relationship).alias("relationship"))

    mod = _tagged("mod", path)
    of_file = F.array_compact(
        F.array(
            edge(_tagged("file", path), mod, "contains"),
            F.when(F.col("db"), edge(mod, _tagged("db", path), "queries_db")),
            F.when(F.col("net"), edge(mod, _tagged("net", path), "fetches_network")),
        )
    )
    from_files = _module_facts(files).filter("is_module").select("repo_id", F.explode_outer(of_file).alias("e"))
    # a route file exists in the repository, so its module node exists iff its path is a module path
    route_node = _tagged("route", F.col("route_id"))
    handles = F.when(
        F.col("file").rlike(java_pattern(V.MODULE_PATH)), edge(_tagged("mod", F.col("file")), route_node, "handles_route")
    )
    accepts = F.transform(
        "inputs",
        lambda i: edge(
            route_node, F.concat(F.lit("input:"), F.col("route_id"), F.lit(":"), i["name"]), "accepts_input"
        ),
    )
    from_routes = routes.select(
        "repo_id", F.explode_outer(F.concat(F.array_compact(F.array(handles)), accepts)).alias("e")
    ).filter(F.col("e").isNotNull())
    return from_files.unionByName(from_routes).select("repo_id", "e.*")


def graph_summary(files: DataFrame, routes: DataFrame) -> DataFrame:
    """Per repository: files, modules, routes, modules with database or network use."""
    return summary_of(_module_facts(files), routes)


def summary_of(facts: DataFrame, routes: DataFrame) -> DataFrame:
    """:func:`graph_summary` from stored :func:`module_facts` of each file."""
    module = F.col("is_module")
    per_file = facts.select(
        "repo_id",
        F.lit(1).alias("f"),
        module.cast("int").alias("m"),
        (module & F.col("db")).cast("int").alias("d"),
        (module & F.col("net")).cast("int").alias("n"),
        F.lit(0).alias("r"),
    )
    per_route = routes.select(
        "repo_id", F.lit(0).alias("f"), F.lit(0).alias("m"), F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(1).alias("r")
    )
    return (
        per_file.unionByName(per_route)
        .groupBy("repo_id")
        .agg(
            F.sum("r").alias("routes_count"),
            F.sum("m").alias("modules_count"),
            F.sum("n").alias("external_calls_count"),
            F.sum("d").alias("database_ops_count"),
            F.sum("f").alias("files_count"),
        )
    )


def correlate_routes(routes: DataFrame, findings: DataFrame) -> DataFrame:
    """Hits for routes with input that reach the database without authorization.

    ``findings`` are those before de-duplication. Only a flag per file is joined.
    """
    unsafe = (
        findings.filter(F.col("file").isNotNull())
        .filter(F.col("rule_id").contains("SQL") | (F.col("category") == "Database"))
        .select("repo_id", "file")
        .distinct()
        .withColumn("unsafe", F.lit(True))
    )
    exposed = routes.filter(
        (F.size("inputs") > 0) & (F.col("database") == "detected") & (F.col("authorization") == "not detected")
    )
    unsafe_db = F.coalesce(F.col("unsafe"), F.lit(False))
    names = F.array_join(F.transform("inputs", lambda i: i["name"]), ", ")
    chain = F.concat(
        F.lit("Route: "),
        F.col("route_id"),
        F.lit(" | Chain: INPUT ("),
        names,
        F.lit(") -> DATABASE QUERY -> "),
        F.when(unsafe_db, F.lit("TEXT BUILT FROM INPUT")).otherwise(F.lit("PARAMETERS NOT VERIFIED")),
        F.lit(" -> NO RESOURCE AUTHORIZATION"),
    )
    return (
        exposed.join(unsafe, ["repo_id", "file"], "left")
        .filter(unsafe_db | (F.col("authentication") == "not detected"))
        .select(
            "repo_id",
            F.col("file").alias("path"),
            F.coalesce(F.col("line"), F.lit(1)).alias("line"),
            chain.alias("text"),
            F.lit(ordinals("CORR")[0]).alias("ord"),
            F.col("route_id").alias("fp_text"),
        )
    )


def number_rows(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """1-based position of each row within its group, without gathering a group in one task.

    Rows are range-partitioned by group and order; a row's position is its place
    in its partition plus the rows of the group in earlier partitions. Only one
    count per (group, partition) passes through the window.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    keys = [F.col(group)] + [F.col(c).asc_nulls_first() for c in order]
    placed = materialize(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    )
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "__part")
        .agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    return (
        placed.join(offsets, [group, "__part"])
        .withColumn(name, F.col("__id") - F.col("__first") + F.col("__before") + 1)
        .drop("__part", "__id", "__first", "__before")
    )


def number_correlations(correlated: DataFrame) -> DataFrame:
    """Display number of each correlated route within its repository: CORR-001, CORR-002, ..."""
    numbered = number_rows(correlated, "repo_id", ["path", "line", "fp_text", "text"], "n")
    digits = F.col("n").cast("string")
    return numbered.withColumn(
        "display_id", F.concat(F.lit("CORR-"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))
    )
