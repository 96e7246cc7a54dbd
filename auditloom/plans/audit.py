"""The whole audit as one plan over a files table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import fixed_values as V
from auditloom.operators import scoring
from auditloom.operators.baseline import baseline_status, new_findings
from auditloom.operators.custom import Analyzer, custom_status, run_custom
from auditloom.operators.dependencies import dependencies, dependency_counts, dependency_hits
from auditloom.operators.digest import explode_hits, rule_hits
from auditloom.operators.env import documented_names, env_evidence, env_hits, env_names, referenced_names
from auditloom.operators.findings import (
    dedup_findings,
    filter_category,
    filter_min_severity,
    filter_rules,
    finding_evidence,
    to_findings,
)
from auditloom.operators.graph import correlate_routes, module_facts, summary_of
from auditloom.operators.manifest import frameworks, manifest, manifest_items
from auditloom.operators.repo_rules import file_facts, repo_facts, repo_hits
from auditloom.operators.reports import json_report, sarif_report
from auditloom.operators.roles import guarded
from auditloom.operators.routes import may_route, routes
from auditloom.operators.rules import Rule
from auditloom.operators.suppress import suppress
from auditloom.session import materialize
from auditloom.sources.files import (
    ROOT_FILES,
    filter_gitignored,
    filter_ignored_paths,
    load_policies,
    load_suppressions,
)


class Audit:
    """Lazily built frames of one audit.

    ``source`` is (repo_id, path, length, content). The order of steps fixes the
    counts: correlate, de-duplicate, suppress, filter, compare with a baseline,
    score. ``listing``, (repo_id, path) of the same files, spares a scan where the caller has it.

    Contents are read once: ``digest`` holds one row per file with its rule hits
    and facts, and keeps the text only of the few files later steps look into
    (root manifests, files with routes or inline markers). With ``durable`` it is
    written to shared storage, and everything after it reads that small table. So are
    the frames that several results start from: names of files and repositories, root files,
    environment names, manifests, inventory, routes and active findings.
    """

    def __init__(
        self,
        source: DataFrame,
        use_policies: bool = False,
        user_rules: Sequence[Rule] = (),
        category: str | None = None,
        min_severity: str | None = None,
        baseline: DataFrame | None = None,
        durable: bool = True,
        analyzers: Mapping[str, Analyzer] | None = None,
        listing: DataFrame | None = None,
    ):
        self.source = source
        self.listed = listing
        self.use_policies = use_policies
        self.user_rules = user_rules
        self.category = category
        self.min_severity = min_severity
        self.baseline = baseline
        self.durable = durable
        self.custom_analyzers = dict(analyzers or {})

    def _settle(self, df: DataFrame) -> DataFrame:
        return materialize(df) if self.durable else df

    def narrowed(self, category: str | None = None, min_severity: str | None = None) -> Audit:
        """This audit under other filters; it shares what is stored up to ``active``, on which filters do not bear."""
        self.active  # noqa: B018
        own = copy(self)
        for later in ("filtered", "findings", "scored", "gates", "evidence", "baseline_counts"):
            own.__dict__.pop(later, None)
        own.category, own.min_severity = category, min_severity
        return own

    @cached_property
    def policies(self) -> DataFrame:
        return load_policies(self.source)

    @cached_property
    def listing(self) -> DataFrame:
        """(repo_id, path) of every file; stored, so that what only needs names scans the source once."""
        return self._settle((self.source if self.listed is None else self.listed).select("repo_id", "path"))

    @cached_property
    def paths(self) -> DataFrame:
        """(repo_id, path) outside ignored paths, of any size; reads no content."""
        return filter_ignored_paths(self.listing, self.policies if self.use_policies else None)

    @cached_property
    def digest(self) -> DataFrame:
        root = F.col("path").isin(*ROOT_FILES)
        kept = filter_ignored_paths(self.source, self.policies if self.use_policies else None)
        marked = F.col("content").contains(V.FILE_MARKER) | F.col("content").contains(V.LINE_MARKER)
        marked = guarded(marked, V.MARKER_WORDS, F.col("low"))
        extra = {
            "in_scope": F.lit(True),
            "documented": documented_names(),
            "referenced": referenced_names(F.col("low")),
            "kept_text": F.when(root | marked | may_route(F.col("low")), F.col("content")),
            **file_facts(F.col("low")),
            **module_facts(F.col("low")),
        }
        return self._settle(rule_hits(kept, user_rules=self.user_rules, keep=["length"], extra=extra))

    @cached_property
    def texts(self) -> DataFrame:
        """The files whose text later steps need, as a files table."""
        return self.digest.filter(F.col("kept_text").isNotNull()).select(
            "repo_id", "path", "length", F.col("kept_text").alias("content")
        )

    @cached_property
    def roots(self) -> DataFrame:
        """The root files among them that speak for their whole repository; stored, as many steps start from these few."""
        return self._settle(self.texts.filter(F.col("path").isin(*ROOT_FILES)))

    @cached_property
    def discovered(self) -> DataFrame:
        """Files the manifest counts, with text for the root files only; ``.gitignore`` applies here."""
        root = F.col("path").isin(*ROOT_FILES)
        roots = self.roots.select("repo_id", "path", "content")
        rest = self.paths.filter(~root).withColumn("content", F.lit(None).cast("string"))
        return self._settle(filter_gitignored(rest.unionByName(roots)))

    @cached_property
    def repos(self) -> DataFrame:
        return self._settle(self.listing.select("repo_id").distinct())

    @cached_property
    def manifests(self) -> DataFrame:
        return self._settle(manifest(self.discovered))

    @cached_property
    def inventory(self) -> DataFrame:
        return self._settle(dependencies(self.roots))

    @cached_property
    def routes(self) -> DataFrame:
        return self._settle(routes(self.texts))

    @cached_property
    def raw(self) -> DataFrame:
        """Findings of every analyzer, before correlation and de-duplication."""
        scope = self.digest.filter("in_scope")
        hits = explode_hits(scope).withColumn("fp_text", F.lit(None).cast("string"))
        hits = hits.unionByName(repo_hits(repo_facts(scope), self.manifests))
        hits = hits.unionByName(dependency_hits(self.inventory)).unionByName(env_hits(self.names, self.roots))
        found = self._settle(to_findings(hits, self.user_rules))
        custom = self.custom[0]
        return found if custom is None else found.unionByName(custom)

    @cached_property
    def names(self) -> DataFrame:
        """Environment names of each repository, documented or referenced."""
        return self._settle(env_names(self.digest.select("repo_id", "documented", "referenced")))

    @cached_property
    def custom(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Findings and states of the custom analyzers, each run apart over the audited files."""
        if not self.custom_analyzers:
            return None, None
        return run_custom(filter_ignored_paths(self.source, self.policies if self.use_policies else None), self.custom_analyzers)

    @cached_property
    def correlated(self) -> DataFrame:
        return to_findings(correlate_routes(self.routes, self.raw))

    @cached_property
    def unique(self) -> DataFrame:
        return dedup_findings(self.raw.unionByName(self.correlated))

    @cached_property
    def active(self) -> DataFrame:
        kept = suppress(self.unique, self.texts, load_suppressions(self.roots))
        return self._settle(filter_rules(kept, self.policies) if self.use_policies else kept)

    @cached_property
    def filtered(self) -> DataFrame:
        out = self.active
        if self.category:
            out = filter_category(out, self.category)
        if self.min_severity:
            out = filter_min_severity(out, self.min_severity)
        return out

    @cached_property
    def findings(self) -> DataFrame:
        """What the audit reports."""
        return new_findings(self.filtered, self.baseline)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.scores(self.findings, self.repos)

    @cached_property
    def gates(self) -> DataFrame:
        return scoring.gate(self.findings, self.repos, self.policies if self.use_policies else None)

    @cached_property
    def analyzers(self) -> DataFrame:
        found, states = self.custom
        built_in = scoring.analyzer_status(self.raw, self.repos)
        return built_in if states is None else built_in.unionByName(custom_status(found, states, self.repos))

    @cached_property
    def evidence(self) -> DataFrame:
        """What each reported finding stands on, every name of a set of names included."""
        return finding_evidence(self.findings, env_evidence(self.names, self.roots))

    @cached_property
    def graph(self) -> DataFrame:
        return summary_of(self.digest.select("repo_id", "path", *module_facts()), self.routes)

    @cached_property
    def baseline_counts(self) -> DataFrame:
        return baseline_status(self.unique, self.active, self.filtered, self.baseline)

    def json_report(self, metadata: Mapping[str, str] | None = None) -> DataFrame:
        """Pieces of one JSON document for each repository, see :func:`reports.json_report`.

        Sections are stored one after another, so that the document's plan holds only their reads
        and the driver never plans and schedules the whole audit in one query.
        """
        stored, scored = self._settle, self._settle(self.scored)
        return json_report(
            self.repos, stored(self.findings), stored(self.evidence), self.manifests, stored(manifest_items(self.discovered)),
            stored(frameworks(self.discovered)), stored(dependency_counts(self.inventory)), self.inventory, self.routes,
            stored(self.graph), stored(self.baseline_counts), scoring.score_report(scored),
            stored(scoring.contributions(self.findings)), scoring.readiness(scored), scoring.category_scores(scored),
            stored(self.analyzers), stored(self.gates), metadata,
        )

    def sarif_report(self) -> DataFrame:
        """Pieces of one SARIF log for each repository."""
        return sarif_report(self.repos, self.findings)


def family_findings(files: DataFrame, selected: Iterable[int]) -> DataFrame:
    """Findings of some rules only; rules that are not selected are not evaluated."""
    return to_findings(explode_hits(rule_hits(files, selected)))
