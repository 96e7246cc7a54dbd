"""Findings: enrichment, identity, de-duplication, filters, search and explanation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.regex import java_pattern, strip
from auditloom.functions.text import constant_array, constant_map, fingerprint, with_masked_snippet
from auditloom.operators import fixed_values as V
from auditloom.operators.prose import prose_of
from auditloom.operators.rules import RULES, Rule
from auditloom.sources.files import small_side

FINDING_COLUMNS = (
    "repo_id",
    "rule_id",
    "title",
    "category",
    "subcategory",
    "analyzer",
    "severity",
    "severity_rank",
    "confidence",
    "file",
    "line",
    "snippet",
    "fingerprint",
    "ord",
)


#: What :func:`enrich_findings` adds; all text but the last, a list.
PROSE_COLUMNS = ("description", "impact", "production_impact", "remediation", "confidence_reason", "references")
#: Rules whose finding stands for a set of names, told in full by :func:`finding_evidence`.
SET_RULES = ("CONFIG-005", "CONFIG-007")


def severity_rank(severity: Column) -> Column:
    return F.element_at(constant_map(V.SEVERITY_RANK), severity)


def sarif_level(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(V.SARIF_LEVEL), severity), F.lit("note"))


def _field(table: Sequence[Rule], name: str) -> Column:
    """Rule attribute of column ``ord``, from a constant array instead of a join."""
    return F.element_at(constant_array(getattr(r, name) for r in table), F.col("ord") + 1)


def to_findings(hits: DataFrame, user_rules: Sequence[Rule] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Hits (repo_id, path, line, text, ord[, fp_text]) to findings, before de-duplication.

    ``fp_text`` is the identity text where it differs from the shown one.
    """
    table = list(RULES) + list(user_rules)
    if "fp_text" not in hits.columns:
        hits = hits.withColumn("fp_text", F.lit(None).cast("string"))
    shown = hits.withColumns(
        {
            "rule_id": _field(table, "rule_id"),
            "title": _field(table, "title"),
            "category": _field(table, "category"),
            "subcategory": _field(table, "subcategory"),
            "analyzer": _field(table, "analyzer"),
            "severity": _field(table, "severity"),
            "confidence": _field(table, "confidence"),
            "key": _field(table, "key"),
            "tag": _field(table, "tag"),
            "shown": strip(F.col("text")),
        }
    )
    shown = with_masked_snippet(shown, "shown", "masked")
    # tokens without a known prefix are hidden as a whole where they are the finding
    snippet = F.when(
        F.col("category") == "Secrets", F.regexp_replace("masked", java_pattern(V.SECRET_JWT), "eyJ******")
    ).otherwise(F.col("masked"))
    shown = shown.withColumns({"snippet": snippet, "severity_rank": severity_rank(F.col("severity"))})
    per_repo = F.col("key") == "R"
    identity = F.when(F.col("category") == "Secrets", F.col("snippet")).otherwise(
        F.coalesce(F.col("fp_text"), F.col("text"))
    )
    return shown.select(
        "*",
        fingerprint(
            F.col("rule_id"),
            F.when(per_repo, F.col("repo_id")).otherwise(F.col("path")),
            F.when(per_repo, F.col("tag")).when(F.col("key") == "C", F.col("category")),
            F.when(F.col("key").isin("L", "C"), identity),
        ).alias("fingerprint"),
        F.col("path").alias("file"),
    ).select(*FINDING_COLUMNS, *keep)


def dedup_findings(findings: DataFrame) -> DataFrame:
    """First finding per (repository, fingerprint), by line and then rule order.

    Rule and path are part of the fingerprint, so a group never exceeds the hits
    of one rule in one file; the minimum is combined before the shuffle.
    """
    rest = [c for c in FINDING_COLUMNS if c not in ("repo_id", "fingerprint")]
    order = F.struct(F.coalesce(F.col("line"), F.lit(0)).alias("l"), F.col("ord").alias("o"), F.col("snippet").alias("s"))
    return (
        findings.groupBy("repo_id", "fingerprint")
        .agg(F.min_by(F.struct(*rest), order).alias("f"))
        .select("repo_id", "fingerprint", "f.*")
        .select(*FINDING_COLUMNS)
    )


def union_findings(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- filters ---------------------------------------------------------------------------


def filter_category(findings: DataFrame, category: str) -> DataFrame:
    return findings.filter(F.lower("category") == category.lower())


def filter_min_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity_rank") >= V.SEVERITY_RANK[severity])


def filter_rules(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Apply each repository's enabled and disabled rule lists.

    A repository without an enabled list keeps every rule.
    """
    listed = policies.select(
        "repo_id", F.explode(F.array_distinct("disabled_rules")).alias("rule_id")
    )
    lists = policies.filter(F.col("enabled_rules").isNotNull()).select("repo_id", F.col("enabled_rules").alias("only"))
    kept = findings.join(small_side(listed), ["repo_id", "rule_id"], "left_anti")
    return (
        kept.join(small_side(lists), "repo_id", "left")
        .filter(F.col("only").isNull() | F.array_contains(F.col("only"), F.col("rule_id")))
        .select(*findings.columns)
    )


def search_findings(findings: DataFrame, query: str = "", severity: str = "ALL") -> DataFrame:
    """Severity chip and case-insensitive substring over title, rule id, file and description."""
    needle = query.lower().strip()
    out = findings if severity == "ALL" else findings.filter(F.col("severity") == severity)
    if not needle:
        return out
    text = F.lower(F.concat_ws(" ", "title", "rule_id", "file", "description"))
    return enrich_findings(out).filter(text.contains(needle)).select(*findings.columns)


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity_rank"), "repo_id", "file", "line", "rule_id", "fingerprint")


# --- report prose -------------------------------------------------------------------------


def rule_catalog(spark: SparkSession, user_rules: Sequence[Rule] = ()) -> DataFrame:
    """One row per way a rule can fire, with the prose shown in reports."""
    table = list(RULES) + list(user_rules)
    facts = ("rule_id", "title", "category", "subcategory", "analyzer", "severity", "confidence")
    rows = []
    for i, r in enumerate(table):
        prose = prose_of(r.rule_id, r.title, r.category)
        rows.append((i, *[getattr(r, n) for n in facts], *[getattr(prose, n) for n in PROSE_COLUMNS]))
    text = [T.StructField(n, T.StringType()) for n in (*facts, *PROSE_COLUMNS[:-1])]
    listed = T.StructField(PROSE_COLUMNS[-1], T.ArrayType(T.StringType()))
    return spark.createDataFrame(rows, T.StructType([T.StructField("ord", T.IntegerType(), False), *text, listed]))


def enrich_findings(findings: DataFrame, user_rules: Sequence[Rule] = ()) -> DataFrame:
    """Attach report prose; the catalog has a fixed number of rows, so it is broadcast.

    Findings of rules that the catalog does not know, of custom analyzers too, get general text.
    """
    prose = rule_catalog(findings.sparkSession, user_rules).select("ord", *PROSE_COLUMNS)
    general = prose_of("", "", "")
    told = {n: F.coalesce(n, F.lit(getattr(general, n))) for n in PROSE_COLUMNS[1:-1]}
    told["description"] = F.coalesce("description", F.concat("title", F.lit(" ("), "category", F.lit(").")))
    told["references"] = F.coalesce("references", F.array().cast("array<string>"))
    return findings.join(F.broadcast(prose), "ord", "left").withColumns(told)


def find_by_id(findings: DataFrame, wanted: str) -> DataFrame:
    """The first finding of every repository whose rule id matches, ignoring case."""
    cols = [c for c in findings.columns if c != "repo_id"]
    order = F.struct(
        F.coalesce(F.col("file"), F.lit("")).alias("f"),
        F.coalesce(F.col("line"), F.lit(0)).alias("l"),
        F.col("fingerprint").alias("p"),
    )
    return (
        findings.filter(F.upper("rule_id") == wanted.upper())
        .groupBy("repo_id")
        .agg(F.min_by(F.struct(*cols), order).alias("f"))
        .select("repo_id", "f.*")
    )


def finding_evidence(findings: DataFrame, named: DataFrame) -> DataFrame:
    """(repo_id, fingerprint, item, file, line, snippet): what each finding stands on.

    ``named`` (repo_id, rule_id, file, name) holds the names of findings that stand for a
    set of them; those have a row for each name, of which a repository may have any
    number. Every other finding has its own place, with an empty item.
    """
    of_sets = F.col("rule_id").isin(*SET_RULES)
    sets = findings.filter(of_sets).select("repo_id", "rule_id", "fingerprint")
    each = named.join(sets, ["repo_id", "rule_id"]).select(
        "repo_id", "fingerprint", F.col("name").alias("item"), "file", F.lit(1).alias("line"), F.col("name").alias("snippet")
    )
    single = findings.filter(~of_sets).select("repo_id", "fingerprint", F.lit("").alias("item"), "file", "line", "snippet")
    return single.unionByName(each)


def flow_steps(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """(repo_id, fingerprint, how): the flows that end on a finding's line, one text; a line holds few."""
    step = F.format_string(
        "%s: %s at %s:%d is set from %s, and at %s:%d reaches %s",
        "kind", "variable", "file", "source_line", "source_expr", "file", "sink_line", "sink_expr",
    )
    ending = flows.select("repo_id", "file", F.col("sink_line").alias("line"), step.alias("step"))
    return (
        findings.select("repo_id", "fingerprint", "file", "line")
        .join(ending, ["repo_id", "file", "line"])
        .groupBy("repo_id", "fingerprint")
        .agg(F.array_join(F.array_sort(F.collect_set("step")), "\n").alias("how"))
    )


def explain(findings: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(repo_id, fingerprint, position, section, body): the record shown for a finding.

    With ``flows`` of the audited files, HOW tells the flows that end on the finding's line;
    where none does, the section is left out, as REFERENCES is for rules without any.
    """
    place = F.concat(F.coalesce(F.col("file"), F.lit("unknown")), F.lit(":"), F.coalesce(F.col("line"), F.lit(1)))
    label = F.when(F.col("subcategory").isNull(), F.col("category")).otherwise(
        F.concat(F.col("category"), F.lit(" ("), F.col("subcategory"), F.lit(")"))
    )
    sections = [
        ("ID", F.col("rule_id")),
        ("TITLE", F.col("title")),
        ("CATEGORY", label),
        ("SEVERITY", F.col("severity")),
        ("CONFIDENCE", F.col("confidence")),
        ("LOCATION", place),
        ("WHAT", F.col("description")),
        ("WHERE", F.concat(place, F.lit(" | "), F.col("snippet"))),
        ("WHY", F.col("confidence_reason")),
        ("IMPACT", F.col("impact")),
        ("PRODUCTION", F.col("production_impact")),
        ("FIX", F.col("remediation")),
        ("REFERENCES", F.array_join("references", "\n")),
    ]
    told = enrich_findings(findings)
    if flows is not None:
        told = told.join(flow_steps(findings, flows), ["repo_id", "fingerprint"], "left")
        sections.insert(next(i for i, (n, _) in enumerate(sections) if n == "IMPACT"), ("HOW", F.col("how")))
    packed = F.array(*[F.struct(F.lit(n).alias("section"), body.alias("body")) for n, body in sections])
    packed = F.filter(packed, lambda s: ~s["section"].isin("HOW", "REFERENCES") | (F.coalesce(s["body"], F.lit("")) != ""))
    return (
        told.select("repo_id", "fingerprint", F.posexplode(packed).alias("position", "s"))
        .select("repo_id", "fingerprint", "position", "s.section", "s.body")
    )
