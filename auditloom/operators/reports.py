"""JSON and SARIF reports: one document a repository, in pieces of text (see :mod:`documents`)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.documents import clean, entries, object_json, one, pieces
from auditloom.operators.findings import enrich_findings, sarif_level

TOOL, VERSION = "auditloom", "0.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def joined(*parts: Column | str) -> Column:
    """A key of several values that sorts as they do; null counts as empty."""
    return F.concat_ws("\u0001", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def place_key(*rest: str) -> Column:
    return joined("file", F.lpad(F.coalesce(F.col("line"), F.lit(0)).cast("string"), 9, "0"), *rest)


def finding_entries(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entries of findings, worst first; each holds the list of all its evidence, however long."""
    told = clean(enrich_findings(findings).drop("ord"))
    key = joined(9 - F.col("severity_rank"), place_key("fingerprint"))
    told = told.withColumns({"__key": key, "__json": object_json(told)})
    part = {"section": F.lit("findings"), "item": F.lit("")}
    opened = F.concat(F.expr("left(__json, length(__json) - 1)"), F.lit(',"evidence":['))
    begin = told.withColumns({**part, "sub": F.lit(0), "entry": F.col("__json"), "text": opened})
    end = told.withColumns({**part, "sub": F.lit(2), "entry": F.lit(None).cast("string"), "text": F.lit("]}")})
    shown = clean(evidence)
    shown = shown.withColumn("__proof", F.to_json(F.struct("file", "line", "snippet")))
    least = shown.groupBy("repo_id", "fingerprint").agg(F.min("item").alias("__least"))
    keyed = told.select("repo_id", "fingerprint", "__key").join(shown, ["repo_id", "fingerprint"]).join(least, ["repo_id", "fingerprint"])
    comma = F.when(F.col("item") > F.col("__least"), F.lit(",")).otherwise(F.lit(""))
    proof = keyed.withColumns({"section": F.lit("evidence"), "sub": F.lit(1), "entry": F.col("__proof"), "text": F.concat(comma, "__proof")})
    rows = [f.select("repo_id", F.col("__key").alias("key"), "sub", "item", "section", "entry", "text") for f in (begin, proof, end)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def json_report(
    repos: DataFrame,
    findings: DataFrame,
    evidence: DataFrame,
    manifests: DataFrame,
    items: DataFrame,
    frameworks: DataFrame,
    dependency_counts: DataFrame,
    inventory: DataFrame,
    routes: DataFrame,
    graph: DataFrame,
    baseline: DataFrame,
    scores: DataFrame,
    explanations: DataFrame,
    readiness: DataFrame,
    categories: DataFrame,
    analyzers: DataFrame,
    gates: DataFrame,
    metadata: Mapping[str, str] | None = None,
) -> DataFrame:
    """Pieces of one JSON document for each repository, with every section; ``metadata`` is told with the gate's outcome."""
    told = {"tool": TOOL, "version": VERSION, **(metadata or {})}
    meta = gates.withColumns({k: F.lit(v) for k, v in told.items()})
    summary = ["overall_score", "status", *[c for c in scores.columns if c.endswith("_count")]]
    return pieces(
        repos,
        [
            '{"project":',
            ("project", one(manifests)),
            ',"scan_metadata":',
            ("scan_metadata", one(meta)),
            ',"technologies":[',
            entries(items, "technologies", joined("kind", "value")),
            '],"frameworks":[',
            entries(frameworks, "frameworks", joined("name", "version")),
            '],"dependency_counts":',
            ("dependency_counts", one(dependency_counts)),
            ',"dependencies":[',
            entries(inventory, "dependencies", joined("name", "version", "type", "source_file")),
            '],"routes":[',
            entries(routes, "routes", place_key("route_id")),
            '],"graph_summary":',
            ("graph_summary", one(graph)),
            ',"baseline_status":',
            ("baseline_status", one(baseline)),
            ',"findings":[',
            finding_entries(findings, evidence),
            '],"scores":',
            ("scores", one(scores)),
            ',"explanations":[',
            entries(explanations, "explanations", joined("dimension", "fingerprint")),
            '],"readiness":',
            ("readiness", one(readiness)),
            ',"categories":[',
            entries(categories, "categories", joined("category")),
            '],"analyzers":[',
            entries(analyzers, "analyzers", joined("analyzer")),
            '],"summary":',
            ("summary", one(scores.select("repo_id", *summary))),
            "}",
        ],
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    return enrich_findings(findings).select(
        "repo_id",
        "rule_id",
        sarif_level(F.col("severity")).alias("level"),
        F.coalesce(F.replace("file", F.lit("\\"), F.lit("/")), F.lit("UNKNOWN")).alias("uri"),
        F.coalesce(F.col("line"), F.lit(1)).alias("start_line"),
        F.concat_ws(": ", "title", "description").alias("message"),
        "fingerprint",
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The first finding of each rule describes it."""
    order = F.struct(
        F.coalesce(F.col("file"), F.lit("")).alias("f"),
        F.coalesce(F.col("line"), F.lit(0)).alias("l"),
        F.col("fingerprint").alias("p"),
    )
    text = F.concat(
        F.col("description"), F.lit("\n\nImpact:\n"), F.col("impact"), F.lit("\n\nRemediation:\n"), F.col("remediation")
    )
    described = enrich_findings(findings).select(
        "repo_id",
        "rule_id",
        order.alias("o"),
        F.struct(
            F.regexp_replace("rule_id", "[^a-zA-Z0-9]", "").alias("name"),
            F.col("title").alias("short_description"),
            F.col("description").alias("full_description"),
            sarif_level(F.col("severity")).alias("level"),
            text.alias("help"),
        ).alias("r"),
    )
    return described.groupBy("repo_id", "rule_id").agg(F.min_by("r", "o").alias("r")).select("repo_id", "rule_id", "r.*")


def numbered_rules(findings: DataFrame) -> DataFrame:
    """:func:`sarif_rules` with rule_index, a rule's place in its repository's log; as many rows a repository as rules, so few."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("rule_id")) - 1
    return sarif_rules(findings).withColumn("rule_index", place)


def sarif_report(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Pieces of one SARIF 2.1.0 log for each repository.

    Rules are numbered first; results then name their rule by its number and stand in
    the order of place, rule and fingerprint.
    """
    findings = clean(findings)
    numbered = numbered_rules(findings)
    rules = numbered.select(
        "repo_id",
        F.lpad(F.col("rule_index").cast("string"), 9, "0").alias("key"),
        F.to_json(
            F.struct(
                F.col("rule_id").alias("id"),
                F.col("name"),
                F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
                F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
                F.struct(F.col("level")).alias("defaultConfiguration"),
                F.struct(F.col("help").alias("text")).alias("help"),
            )
        ).alias("entry"),
        F.lit("rules").alias("section"),
    )
    told = sarif_results(findings).join(numbered.select("repo_id", "rule_id", "rule_index"), ["repo_id", "rule_id"])
    results = told.select(
        "repo_id",
        joined("uri", F.lpad(F.col("start_line").cast("string"), 9, "0"), "rule_id", "fingerprint").alias("key"),
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                F.col("rule_index").alias("ruleIndex"),
                F.struct(F.col("message").alias("text")).alias("message"),
                F.col("level"),
                F.array(
                    F.struct(
                        F.struct(
                            F.struct(F.col("uri").alias("uri")).alias("artifactLocation"),
                            F.struct(F.col("start_line").alias("startLine")).alias("region"),
                        ).alias("physicalLocation")
                    )
                ).alias("locations"),
                F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"),
            )
        ).alias("entry"),
        F.lit("results").alias("section"),
    )
    rules, results = (r.withColumns({"sub": F.lit(0), "item": F.lit(""), "text": F.col("entry")}) for r in (rules, results))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","semanticVersion":"{VERSION}","rules":['
    return pieces(repos, [head, rules, ']}},"results":[', results, "]}]}"])


#: What a log's entries say, for reading them back as rows.
SARIF_ENTRY = (
    "id string, name string, fullDescription struct<text:string>, defaultConfiguration struct<level:string>, help struct<text:string>,"
    " ruleId string, ruleIndex int, message struct<text:string>, level string,"
    " locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,"
    " partialFingerprints struct<primaryLocationLineHash:string>"
)


def sarif_rows(log: DataFrame) -> DataFrame:
    """Rules and results of the pieces of logs, as flat rows."""
    e = F.from_json("entry", SARIF_ENTRY)
    parsed = log.where("entry is not null").select("repo_id", "section", "key", e.alias("e"))
    place = F.get(F.col("e.locations"), F.lit(0))["physicalLocation"]
    return parsed.select(
        "repo_id",
        "section",
        F.coalesce("e.ruleIndex", F.col("key").try_cast("int")).alias("rule_index"),
        F.coalesce("e.id", "e.ruleId").alias("rule_id"),
        F.coalesce("e.defaultConfiguration.level", "e.level").alias("level"),
        F.coalesce("e.help.text", "e.message.text").alias("text"),
        F.coalesce("e.name", place["artifactLocation"]["uri"]).alias("place"),
        place["region"]["startLine"].alias("start_line"),
        F.coalesce("e.fullDescription.text", "e.partialFingerprints.primaryLocationLineHash").alias("told"),
    )
