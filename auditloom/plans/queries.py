"""Every operator as a named query over the given tables.

Results are flat: arrays are joined to text, counts are BIGINT, lines are INT.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.regex import java_pattern, strip
from auditloom.functions.text import fingerprint, normalize_path, strip_ansi, with_masked_secret, with_masked_snippet
from auditloom.operators import baseline as B
from auditloom.operators import dependencies as D
from auditloom.operators import documents as DOC
from auditloom.operators import env as E
from auditloom.operators import findings as FD
from auditloom.operators import fixed_values as V
from auditloom.operators import flows as FL
from auditloom.operators import graph as G
from auditloom.operators import manifest as M
from auditloom.operators import reports as R
from auditloom.operators import routes as RT
from auditloom.operators import scoring as S
from auditloom.operators import suppress as SP
from auditloom.operators.digest import explode_hits, explode_lines, rule_hits
from auditloom.operators.repo_rules import facts_of, repo_hits
from auditloom.operators.roles import file_flags, with_names
from auditloom.operators.rules import FAMILIES, RULES, Rule, family_rules
from auditloom.plans.audit import Audit, family_findings
from auditloom.session import shared_dir, spread
from auditloom.sources.corpus import corpus_files, corpus_paths
from auditloom.sources.files import (
    filter_extension,
    filter_gitignored,
    filter_ignored_paths,
    filter_size,
    gitignore_patterns,
    load_policies,
    load_suppressions,
    scan_files,
)
from auditloom.sources.tree import write_tree
from auditloom.streaming.incremental import read_file_stream, start_incremental_audit

Query = Callable[[SparkSession, str], DataFrame]

SHORT = ("repo_id", "rule_id", "severity", "confidence", "file", "line", "snippet", "fingerprint")
QUERIES: dict[str, Query] = {}
#: Audits of this process by application, source and options: their stored tables serve all queries over them.
_AUDITS: dict[tuple[str, str, str], Audit] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_ignored_paths(corpus_files(spark, sf_dir))


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_gitignored(filter_ignored_paths(corpus_files(spark, sf_dir)))


def _audit(spark: SparkSession, sf_dir: str, category: str | None = None, min_severity: str | None = None, **options) -> Audit:
    key = (spark.sparkContext.applicationId, sf_dir, repr(sorted(options.items())))
    if key not in _AUDITS:
        _AUDITS[key] = Audit(corpus_files(spark, sf_dir), listing=corpus_paths(spark, sf_dir), **options)
    return _AUDITS[key].narrowed(category, min_severity) if category or min_severity else _AUDITS[key]


def _only(families: set[str]) -> list[int]:
    return [i for i, r in enumerate(RULES) if r.family in families]


# --- sources and file predicates ----------------------------------------------------------


@query
def files_by_size(spark, sf_dir):
    """The size filter alone, at a length that the corpus has files on both sides of."""
    return filter_size(corpus_files(spark, sf_dir), 2000).select("repo_id", "path", "length")


@query
def corpus(spark, sf_dir):
    return corpus_files(spark, sf_dir).select("repo_id", "path", "length", F.md5("content").alias("content_md5"))


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/auditloom-{uuid.uuid4().hex}"


@query
def scanned_tree(spark, sf_dir):
    """The corpus written as a tree of files, then listed and read by tasks."""
    root = _new_folder(spark)
    write_tree(corpus_files(spark, sf_dir), root)
    return scan_files(spark, root).select("repo_id", "path", "length", F.md5("content").alias("content_md5"))


@query
def lines(spark, sf_dir):
    return explode_lines(_files(spark, sf_dir))


@query
def files_by_extension(spark, sf_dir):
    return filter_extension(corpus_files(spark, sf_dir), [".js", ".py", "Dockerfile"]).select("repo_id", "path", "length")


@query
def ignored_paths(spark, sf_dir):
    return filter_ignored_paths(corpus_files(spark, sf_dir)).select("repo_id", "path")


@query
def ignored_paths_by_policy(spark, sf_dir):
    files = corpus_files(spark, sf_dir)
    return filter_ignored_paths(files, load_policies(files)).select("repo_id", "path")


@query
def gitignore(spark, sf_dir):
    return gitignore_patterns(corpus_files(spark, sf_dir))


@query
def gitignored_files(spark, sf_dir):
    return filter_gitignored(corpus_files(spark, sf_dir)).select("repo_id", "path")


@query
def policies(spark, sf_dir):
    lists = ("ignored_paths", "enabled_rules", "disabled_rules")
    found = load_policies(corpus_files(spark, sf_dir))
    return found.withColumns({n: F.array_join(n, ",") for n in lists})


@query
def suppressions(spark, sf_dir):
    return load_suppressions(corpus_files(spark, sf_dir))


@query
def file_roles(spark, sf_dir):
    names = (
        "is_code", "api_path", "auth_api_path", "admin_path", "client_component", "log_skipped", "rel_test_doc",
        "data_test", "config_path", "prod_path", "is_dockerfile", "is_compose", "is_ci", "env_file", "is_python",
    )
    flags = file_flags()
    return with_names(_files(spark, sf_dir)).select("repo_id", "path", "ext", *[flags[n]().alias(n) for n in names])


@query
def content_flags(spark, sf_dir):
    names = ("has_jwt_verify", "has_hashing", "has_http_only", "has_credentials", "has_body", "has_server_marker")
    flags = file_flags()
    return with_names(_files(spark, sf_dir)).select("repo_id", "path", *[flags[n]().alias(n) for n in names])


@query
def strip_comments(spark, sf_dir):
    code = F.regexp_replace("content", java_pattern(V.COMMENTS), "")
    return _files(spark, sf_dir).select("repo_id", "path", F.md5(code).alias("code_md5"), F.length(code).alias("code_chars"))


@query
def comment_lines(spark, sf_dir):
    t = strip(F.col("text"))
    return (
        explode_lines(_files(spark, sf_dir))
        .groupBy("repo_id", "path")
        .agg(
            F.count("*").alias("line_count"),
            F.count_if(t.startswith("//") | t.startswith("#")).alias("comment_count"),
        )
    )


# --- detection rules --------------------------------------------------------------------------


def _family(name: str) -> Query:
    def run(spark, sf_dir):
        if name == "corr":
            return FD.dedup_findings(_audit(spark, sf_dir).correlated).select(*SHORT)
        chosen = family_rules(name)
        files = _files(spark, sf_dir)
        scopes = {RULES[i].scope for i in chosen}
        frames = []
        if scopes - {"repo"}:
            frames.append(family_findings(files, chosen))
        if name in ("headers", "obs", "tst", "cfg", "pkg"):
            found = repo_hits(facts_of(files), M.manifest(_discovered(spark, sf_dir)))
            frames.append(FD.to_findings(found.filter(F.col("ord").isin(chosen))))
        if name == "pkg":
            frames.append(FD.to_findings(D.dependency_hits(D.dependencies(corpus_files(spark, sf_dir)))))
        if name == "config":
            frames.append(FD.to_findings(E.env_hits(E.env_names(E.env_rows(files)), files)))
        return FD.union_findings(*frames).select(*SHORT)

    return run


for _name in FAMILIES:
    QUERIES[f"rules_{_name}"] = _family(_name)


@query
def secrets_in_documents(spark, sf_dir):
    """Secret rules over the untouched texts."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), "doc_id")
    files = docs.select(
        F.col("source").alias("repo_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").alias("content"),
    )
    return FD.dedup_findings(family_findings(files, family_rules("secret"))).select(*SHORT)


@query
def config_in_pages(spark, sf_dir):
    """Configuration and secret rules over the untouched web pages, one repository per host."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    files = pages.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo_id"),
        F.concat(F.lit("prod/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("long").alias("length"),
        F.col("html").alias("content"),
    )
    chosen = _only({"config", "secret", "cfg"})
    return FD.dedup_findings(family_findings(files, chosen)).select(*SHORT)


@query
def custom_rule(spark, sf_dir):
    """A user rule evaluated in the same pass as the built-in ones."""
    todo = Rule(
        "USER-001", "user", "user", "Reliability", "LOW", "HIGH", "C", "Settings object", "line",
        lambda ln: ln.flag("is_code") & ln.text.contains("settings"),
    )
    hits = explode_hits(rule_hits(_files(spark, sf_dir), family_rules("code"), user_rules=[todo]))
    return FD.to_findings(hits, [todo]).filter(F.col("rule_id") == "USER-001").select(*SHORT)


# --- scalar functions ----------------------------------------------------------------------------


@query
def fingerprints(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.lit("a\\"), F.col("conv_id").cast("string"), F.lit("\\t"), F.col("turn").cast("string"))
    return conv.select(
        "conv_id",
        "turn",
        normalize_path(path).alias("path"),
        fingerprint(F.lit("CONV-001"), path, F.col("role"), F.col("text")).alias("fingerprint"),
    )


@query
def mask_documents(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    out = with_masked_snippet(docs, "text", "masked")
    return out.select(
        "doc_id", F.md5("masked").alias("masked_md5"), (F.col("masked") != F.col("text")).alias("changed")
    )


@query
def mask_lines(spark, sf_dir):
    found = explode_lines(_files(spark, sf_dir)).filter(F.col("text").rlike("(?i)secret|key|token|pass|://"))
    return with_masked_snippet(found, "text", "masked").select("repo_id", "path", "line", "masked")


@query
def mask_secrets(spark, sf_dir):
    """Each blank-separated word of the corpus lines that look like assignments, masked as one secret."""
    found = explode_lines(_files(spark, sf_dir)).filter(F.col("text").rlike("['\"]"))
    words = found.select(
        "repo_id", "path", "line", F.posexplode(F.split("text", "[ '\"`;,]+")).alias("n", "word")
    )
    return with_masked_secret(words, "word", "masked").drop("word")


@query
def strip_ansi_codes(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    coloured = F.concat(F.lit("\u001b[1;31m"), F.col("role"), F.lit("\u001b[0m "), F.col("text"))
    return conv.select("conv_id", "turn", strip_ansi(coloured).alias("plain"))


# --- identity, suppression, filters -------------------------------------------------------------


@query
def dedup(spark, sf_dir):
    return _audit(spark, sf_dir).unique.select(*SHORT)


@query
def suppress_list(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return SP.suppress_by_list(a.unique, load_suppressions(a.roots)).select(*SHORT)


@query
def suppress_inline(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return SP.suppress_inline(a.unique, a.texts).select(*SHORT)


@query
def inline_markers(spark, sf_dir):
    files = corpus_files(spark, sf_dir)
    whole = SP.file_markers(files).select("repo_id", "path", F.lit(0).alias("line"), "marker")
    return whole.unionByName(SP.line_markers(files))


@query
def filter_category(spark, sf_dir):
    return _audit(spark, sf_dir, category="sEcUrItY").filtered.select(*SHORT)


@query
def filter_severity(spark, sf_dir):
    return _audit(spark, sf_dir, min_severity="HIGH").filtered.select(*SHORT)


@query
def rule_policy(spark, sf_dir):
    """The audit with every repository's own ignored paths and rule lists."""
    return _audit(spark, sf_dir, use_policies=True).findings.select(*SHORT)


@query
def search(spark, sf_dir):
    return FD.search_findings(_audit(spark, sf_dir).findings, " SQL ", "CRITICAL").select(*SHORT)


@query
def sorted_findings(spark, sf_dir):
    return FD.sort_findings(_audit(spark, sf_dir).findings).select(*SHORT)


@query
def enriched(spark, sf_dir):
    return FD.enrich_findings(_audit(spark, sf_dir).findings).select(
        "repo_id", "fingerprint", "rule_id", "title", "category", "subcategory", "analyzer", "severity_rank",
        "description", "impact", "production_impact", "remediation", "confidence_reason",
        F.array_join("references", "\n").alias("sources"),
    )


@query
def evidence(spark, sf_dir):
    """What every finding stands on, with all names of CONFIG-005 and CONFIG-007."""
    return _audit(spark, sf_dir).evidence


@query
def explain_flows(spark, sf_dir):
    """The records of all findings that a flow ends on, with HOW."""
    found, flows = _audit(spark, sf_dir).findings, FL.taint_flows(_files(spark, sf_dir))
    return FD.explain(found.join(FD.flow_steps(found, flows), ["repo_id", "fingerprint"], "left_semi"), flows)


@query
def explain(spark, sf_dir):
    found = FD.find_by_id(_audit(spark, sf_dir).findings, "code-004")
    return FD.explain(found)


# --- baselines --------------------------------------------------------------------------------------


def _high(a: Audit) -> DataFrame:
    """A baseline taken earlier from the HIGH and CRITICAL findings."""
    return B.make_baseline(FD.filter_min_severity(a.active, "HIGH"))


@query
def distinct_fingerprints(spark, sf_dir):
    return B.make_baseline(_audit(spark, sf_dir).active).select("repo_id", "fingerprint")


@query
def baseline_new(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return B.new_findings(a.active, _high(a)).select(*SHORT)


@query
def baseline_stored(spark, sf_dir):
    """New findings by a stored baseline: of all findings first, then replaced by the HIGH and CRITICAL ones."""
    a, path = _audit(spark, sf_dir), _new_folder(spark)
    B.write_baseline(a.active, path)
    B.write_baseline(FD.filter_min_severity(a.active, "HIGH"), path)
    return B.new_findings(a.active, B.read_baseline(spark, path)).select(*SHORT)


@query
def baseline_updated(spark, sf_dir):
    """New findings by a baseline of the HIGH and CRITICAL ones in which some repositories got all of theirs."""
    a, path = _audit(spark, sf_dir), _new_folder(spark)
    B.write_baseline(FD.filter_min_severity(a.active, "HIGH"), path)
    B.update_baseline(a.active, a.repos.where("length(repo_id) % 2 = 0"), path)
    B.update_baseline(a.active.where("false"), a.repos.where("repo_id = 'absent'"), path)
    return B.new_findings(a.active, B.read_baseline(spark, path)).select(*SHORT)


@query
def baseline_known(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return B.known_findings(a.active, _high(a)).select(*SHORT)


@query
def baseline_status(spark, sf_dir):
    a = _audit(spark, sf_dir, min_severity="LOW")
    return B.baseline_status(a.unique, a.active, a.filtered, _high(a))


@query
def incremental(spark, sf_dir):
    """The corpus as a stream of micro-batches; every file comes again, a month late, and no finding is told twice."""
    folder, files = _new_folder(spark), corpus_files(spark, sf_dir)
    for days in (40, 10):
        arrived = files.withColumn("arrived_at", F.timestamp_seconds(F.lit(days * 86_400) + F.crc32("path") % 3600))
        arrived.write.mode("append").parquet(f"{folder}/inbox")
    each = max(1, spark.sparkContext.defaultParallelism // 2)
    stream = start_incremental_audit(
        read_file_stream(spark, f"{folder}/inbox", each),
        lambda new, number: new.write.mode("overwrite").parquet(f"{folder}/new/batch={number}"),
        f"{folder}/checkpoint",
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/new").select(*SHORT)


# --- environment and dependencies ---------------------------------------------------------------------


@query
def undocumented_env(spark, sf_dir):
    files = _files(spark, sf_dir)
    return E.undocumented_env(E.env_names(E.env_rows(files)), files)


@query
def missing_env(spark, sf_dir):
    files = _files(spark, sf_dir)
    return E.missing_env(E.env_names(E.env_rows(files)), files)


@query
def first_names(spark, sf_dir):
    return E.first_names(E.env_references(_files(spark, sf_dir)))


@query
def dependencies(spark, sf_dir):
    return D.dependencies(corpus_files(spark, sf_dir))


@query
def dependency_counts(spark, sf_dir):
    return D.dependency_counts(D.dependencies(corpus_files(spark, sf_dir)))


@query
def deny_listed(spark, sf_dir):
    return D.deny_listed(D.dependencies(corpus_files(spark, sf_dir)))


@query
def advisories(spark, sf_dir):
    """Inventory against an advisory table taken from the lockfiles of the corpus."""
    files = corpus_files(spark, sf_dir)
    known = (
        D.lock_dependencies(files)
        .select("name", "version")
        .distinct()
        .withColumn("advisory", F.concat(F.lit("ADV-"), F.upper("name")))
    )
    return D.advisory_match(D.dependencies(files), known)


@query
def advisories_not_configured(spark, sf_dir):
    return D.advisory_match(D.dependencies(corpus_files(spark, sf_dir)), None)


# --- scores ---------------------------------------------------------------------------------------------


@query
def severity_counts(spark, sf_dir):
    return S.severity_counts(_audit(spark, sf_dir).findings)


@query
def contributions(spark, sf_dir):
    return S.contributions(_audit(spark, sf_dir).findings)


@query
def scores(spark, sf_dir):
    return S.score_report(_audit(spark, sf_dir).scored)


@query
def scores_of_quiet_repos(spark, sf_dir):
    """Scores from Testing findings alone: most repositories have none and stay at 100."""
    a = _audit(spark, sf_dir, category="Testing")
    return S.score_report(a.scored)


@query
def readiness(spark, sf_dir):
    return S.readiness(_audit(spark, sf_dir).scored)


@query
def category_scores(spark, sf_dir):
    return S.category_scores(_audit(spark, sf_dir).scored)


@query
def gate(spark, sf_dir):
    a = _audit(spark, sf_dir, category="Testing")
    return S.gate(a.findings, a.repos, load_policies(a.roots))


@query
def severity_share(spark, sf_dir):
    a = _audit(spark, sf_dir, category="Testing")
    return S.severity_share(a.findings, a.repos)


@query
def gate_of_all(spark, sf_dir):
    """The gate over every finding, by each repository's own threshold."""
    a = _audit(spark, sf_dir)
    return S.gate(a.findings, a.repos, load_policies(a.roots))


@query
def severity_share_of_all(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return S.severity_share(a.findings, a.repos)


@query
def baseline_status_without(spark, sf_dir):
    """Counts where no baseline is given: nothing is known, suppressed findings still count."""
    return _audit(spark, sf_dir).baseline_counts


@query
def analyzer_status(spark, sf_dir):
    return _audit(spark, sf_dir).analyzers


def _broken(files: DataFrame) -> DataFrame:
    """An analyzer that fails only when its rows are computed."""
    return family_findings(files, family_rules("code")).withColumn("line", F.raise_error(F.lit("broken")).cast("int"))


@query
def custom_analyzers(spark, sf_dir):
    """An audit with an analyzer of the user's and one that fails: states and counts of all."""
    own = {"own": lambda files: family_findings(files, family_rules("code")), "broken": _broken}
    return Audit(corpus_files(spark, sf_dir), analyzers=own, listing=corpus_paths(spark, sf_dir)).analyzers


# --- discovery, routes, graph, flows -------------------------------------------------------------------------


@query
def manifest(spark, sf_dir):
    return M.manifest(_discovered(spark, sf_dir))


@query
def manifest_items(spark, sf_dir):
    return M.manifest_items(_discovered(spark, sf_dir))


@query
def frameworks(spark, sf_dir):
    return M.frameworks(_discovered(spark, sf_dir))


@query
def languages(spark, sf_dir):
    named = with_names(_files(spark, sf_dir)).withColumn("language", M.language_of(F.col("ext")))
    return named.filter(F.col("language").isNotNull()).groupBy("repo_id", "language").agg(F.count("*").alias("files"))


def _flat_routes(found: DataFrame) -> DataFrame:
    inputs = F.array_join(F.transform("inputs", lambda i: F.concat(i["name"], F.lit("="), i["source"])), ",")
    return found.withColumns({"inputs": inputs, "risk_flags": F.array_join("risk_flags", ",")})


@query
def routes_next_app(spark, sf_dir):
    return _flat_routes(RT.routes_next_app(_files(spark, sf_dir)))


@query
def routes_next_pages(spark, sf_dir):
    return _flat_routes(RT.routes_next_pages(_files(spark, sf_dir)))


@query
def routes_express(spark, sf_dir):
    return _flat_routes(RT.routes_express(_files(spark, sf_dir)))


@query
def routes_python(spark, sf_dir):
    return _flat_routes(RT.routes_python(_files(spark, sf_dir)))


@query
def api_surface(spark, sf_dir):
    return RT.api_surface(RT.routes(_files(spark, sf_dir)))


@query
def flows(spark, sf_dir):
    return FL.taint_flows(_files(spark, sf_dir))


@query
def correlate(spark, sf_dir):
    a = _audit(spark, sf_dir)
    numbered = G.number_correlations(G.correlate_routes(a.routes, a.raw))
    return numbered.select("repo_id", "display_id", "path", "line", F.col("fp_text").alias("route_id"), "text")


@query
def graph_nodes(spark, sf_dir):
    files = _files(spark, sf_dir)
    return G.graph_nodes(files, RT.routes(files))


@query
def graph_edges(spark, sf_dir):
    files = _files(spark, sf_dir)
    return G.graph_edges(files, RT.routes(files))


@query
def graph_summary(spark, sf_dir):
    files = _files(spark, sf_dir)
    return G.graph_summary(files, RT.routes(files))


# --- reports -----------------------------------------------------------------------------------------------------


@query
def json_report(spark, sf_dir):
    """Every field of every object of the repositories' documents."""
    a = _audit(spark, sf_dir)
    return DOC.flat(a.json_report())


@query
def sarif_results(spark, sf_dir):
    return R.sarif_results(_audit(spark, sf_dir).findings)


@query
def sarif_rules(spark, sf_dir):
    return R.sarif_rules(_audit(spark, sf_dir).findings)


@query
def sarif_report(spark, sf_dir):
    """Rules and results of the repositories' logs, read back from their pieces."""
    return R.sarif_rows(_audit(spark, sf_dir).sarif_report())


@query
def written_reports(spark, sf_dir):
    """Both documents of each repository written as files: their lengths by kind."""
    a, folder = _audit(spark, sf_dir), _new_folder(spark)
    logs = DOC.write_documents(a.sarif_report(), f"{folder}/sarif", ".sarif").withColumn("kind", F.lit("sarif"))
    told = DOC.write_documents(a.json_report(), f"{folder}/json").withColumn("kind", F.lit("json"))
    return logs.unionByName(told).select("repo_id", "kind", "file", (F.col("bytes") > 0).alias("filled"))
