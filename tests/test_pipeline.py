"""Audit steps on hand-written repositories and against brute force."""

import json
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.operators import baseline as B
from auditloom.operators import dependencies as D
from auditloom.operators import documents as DOC
from auditloom.operators import env as E
from auditloom.operators import findings as FD
from auditloom.operators import fixed_values as V
from auditloom.operators import flows as FL
from auditloom.operators import graph as G
from auditloom.operators import routes as RT
from auditloom.operators import scoring as S
from auditloom.operators import suppress as SP
from auditloom.operators.custom import run_custom
from auditloom.operators.digest import explode_hits, rule_hits
from auditloom.operators.prose import RULE_PROSE
from auditloom.plans.audit import Audit, family_findings
from auditloom.plans.queries import _audit
from auditloom.sources.corpus import corpus_files, corpus_paths
from auditloom.sources.files import filter_ignored_paths, load_policies
from auditloom.streaming.incremental import dealt
from tests.conftest import SF_DIR

FINDING = (
    "repo_id string, rule_id string, title string, category string, subcategory string, analyzer string, severity string,"
    " severity_rank int, confidence string, file string, line int, snippet string, fingerprint string, ord int"
)


def findings(spark, rows):
    full = [
        (repo, rule, "t", cat, None, "a", sev, V.SEVERITY_RANK[sev], conf, "f.js", 1, "s", f"fp{i}", 0)
        for i, (repo, rule, cat, sev, conf) in enumerate(rows)
    ]
    return spark.createDataFrame(full, FINDING)


def repos(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "repo_id string")


def test_scores(spark):
    found = findings(
        spark,
        [
            ("one", "SECRET-001", "Secrets", "CRITICAL", "HIGH"),
            ("two", "API-001", "API", "HIGH", "MEDIUM"),
            ("three", "CODE-001", "Security", "HIGH", "HIGH"),
            ("many", "X", "Configuration", "MEDIUM", "LOW"),
        ],
    )
    got = {r.repo_id: r for r in S.score_report(S.scores(found, repos(spark, "none", "one", "two", "three", "many"))).collect()}
    none = got["none"]
    assert {none[f"{d.lower()}_score"] for d in S.DIMENSIONS} == {100}
    assert (none.overall_score, none.status) == (100, "READY")
    assert (got["one"].security_score, got["one"].status) == (80, "NOT_READY")
    assert (got["two"].architecture_score, got["two"].status) == (92, "NEEDS_ATTENTION")
    assert (got["three"].security_score, got["three"].reliability_score) == (90, 90)
    # 5 * 0.5 rounds half up to 3, of which 0.75 rounds to 2
    assert (got["many"].configuration_score, got["many"].production_score) == (97, 98)


def test_gate(spark):
    found = findings(spark, [("low", "A", "API", "LOW", "HIGH"), ("crit", "B", "API", "CRITICAL", "HIGH")])
    policies = spark.createDataFrame([("low", "LOW")], "repo_id string, fail_threshold string")
    every = repos(spark, "none", "low", "crit")
    assert {r.repo_id: r.exit_code for r in S.gate(found, every).collect()} == {"none": 0, "low": 1, "crit": 2}
    assert {r.repo_id: r.exit_code for r in S.gate(found, every, policies).collect()}["low"] == 2


def test_readiness_labels(spark):
    found = findings(
        spark,
        [
            ("r", "DEP-003", "Deployment", "CRITICAL", "HIGH"),
            ("r", "OBS-001", "Observability", "INFO", "HIGH"),
            ("r", "TST-001", "Testing", "LOW", "HIGH"),
        ],
    )
    row = S.readiness(S.scores(found, repos(spark, "r", "q"))).filter("repo_id = 'r'").collect()[0]
    assert (row.deployment, row.observability, row.testing) == ("RISKY", "LIMITED", "NONE")


def test_baseline_round_trip(spark, make_files, tmp_path):
    files = make_files({("a", "x.js"): "eval(a);\neval(b);", ("b", "x.js"): "eval(a);"})
    found = FD.dedup_findings(family_findings(files, [i for i in FD_CODE]))
    path = str(tmp_path / "baseline")
    B.write_baseline(found, path)
    known = B.read_baseline(spark, path)
    assert B.new_findings(found, known).count() == 0
    assert B.known_findings(found, known).count() == found.count() == 3
    with pytest.warns(UserWarning, match="no baseline"):
        assert B.read_baseline(spark, str(tmp_path / "absent")) is None
    assert B.new_findings(found, None).count() == 3
    first = B.baseline_versions(spark, path).first()["version"]
    assert B.write_baseline(found.where("repo_id = 'a'"), path) != first
    assert B.new_findings(found, B.read_baseline(spark, path)).count() == 1  # the later version holds
    assert B.new_findings(found, B.read_baseline(spark, path, first)).count() == 0
    B.update_baseline(found.where("line = 1"), repos(spark, "a"), path)
    B.update_baseline(found, repos(spark, "b", "c"), path)
    assert [(r.repo_id, r.line) for r in B.new_findings(found, B.read_baseline(spark, path)).collect()] == [("a", 2)]
    (tmp_path / "baseline" / "begun").mkdir()  # a version that was never named is not seen
    assert B.read_baseline(spark, path).count() == 2 and B.baseline_versions(spark, path).count() == 4
    empty = B.baseline_status(found, found, found, None).collect()
    assert {(r.repo_id, r.total_findings, r.new_findings, r.suppressed_findings) for r in empty} == {("a", 2, 2, 0), ("b", 1, 1, 0)}


FD_CODE = [i for i, r in enumerate(FD.RULES) if r.family == "code"]


def test_inline_suppression(spark, make_files):
    files = make_files(
        {
            ("r", "line.js"): "// audit-ignore-line CODE-001\neval(a);\neval(b);\neval(c); // audit-ignore-line CODE-001\neval(d);\neval(e);",
            ("r", "split.js"): "// CODE-001\neval(a); // audit-ignore-line",
            ("r", "file.js"): "eval(a);\n/* audit-ignore-file CODE-001 */\nnew Function(b);",
            ("r", "other.js"): "// audit-ignore-line CODE-002\neval(a);",
            ("s", "file.js"): "eval(a);",
        }
    )
    found = FD.dedup_findings(family_findings(files, FD_CODE))
    kept = sorted((r.repo_id, r.file, r.rule_id, r.line) for r in SP.suppress_inline(found, files).collect())
    assert kept == [
        ("r", "file.js", "CODE-002", 3),
        ("r", "line.js", "CODE-001", 3),
        ("r", "line.js", "CODE-001", 6),
        ("r", "other.js", "CODE-001", 2),
        ("s", "file.js", "CODE-001", 1),
    ]


def test_list_suppression(spark, make_files):
    files = make_files({("r", "a.js"): "eval(a);\nnew Function(b);", ("s", "a.js"): "eval(a);"})
    found = FD.dedup_findings(family_findings(files, FD_CODE)).cache()
    fp = found.filter("repo_id = 'r' and rule_id = 'CODE-002'").collect()[0].fingerprint
    tokens = spark.createDataFrame([("r", "CODE-001"), ("r", fp)], "repo_id string, token string")
    kept = SP.suppress_by_list(found, tokens).collect()
    assert [(r.repo_id, r.rule_id) for r in kept] == [("s", "CODE-001")]


def test_policies(spark, make_files):
    files = make_files(
        {
            ("bad", ".auditrc"): "{",
            ("bad", "audit.config.json"): '{"failThreshold": "LOW"}',
            ("first", ".auditrc"): '{"ignoredPaths": ["gen"]}',
            ("first", "gen/a.js"): "x",
            ("first", "dist/a.js"): "x",
            ("none", "dist/a.js"): "x",
            ("none", "src/dist.js"): "x",
            ("wrong", ".auditrc"): '{"failThreshold": "NEVER"}',
        }
    )
    policies = load_policies(files)
    got = {r.repo_id: (r.policy_file, r.fail_threshold) for r in policies.collect()}
    assert got == {"bad": ("audit.config.json", "LOW"), "first": (".auditrc", "HIGH")}
    kept = {(r.repo_id, r.path) for r in filter_ignored_paths(files, policies).collect()}
    assert ("first", "gen/a.js") not in kept and ("first", "dist/a.js") in kept
    assert ("none", "dist/a.js") not in kept and ("none", "src/dist.js") in kept


def test_number_rows_matches_window(spark):
    # one group holds most rows
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("k"),
    )
    w = Window.partitionBy("g").orderBy("k")
    expected = {(r.g, r.k): r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert {(r.g, r.k): r.n for r in G.number_rows(df, "g", ["k"], "n").collect()} == expected


def test_flows_match_brute_force(spark, make_files):
    text = "\n".join(
        [
            "const a = req.query.a;",
            "db.query('x' + a);",
            "const a = req.body.b;",
            "exec(a); fs.readFile(a)",
            "exec(ab); exec(b_a)",
            "const u = req.params.u; fetch(u);",
            "db.query(u);",
            "const 1x = req.query.z; exec(1x)",
        ]
    )
    rows = FL.taint_flows(make_files({("r", "f.js"): text, ("r", "f.txt"): text})).collect()
    got = sorted((r.kind, r.sink_line, r.variable, r.source_line) for r in rows)
    sources, expected = {}, []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.search(V.SOURCE_ASSIGNMENT, line, re.I)
        if m:
            sources[m.group(1)] = n
        for kind, rx in V.FLOW_SINKS.items():
            if re.search(rx, line, re.I):
                for var, at in sources.items():
                    if re.match("[a-zA-Z_]", var) and re.search(rf"\b{var}\b", line) and (kind != "sql" or "+" in line):
                        expected.append((kind, n, var, at))
    assert got == sorted(expected)
    assert ("exec", 4, "a", 3) in got and ("ssrf", 6, "u", 6) in got


def test_route_context_and_lines(spark, make_files):
    far = "x" * 250
    text = (
        f"{far}\napp.get('/one', (req, res) => {{ db.query(req.query.a) }});\n"
        + "y" * 1600
        + "\nrouter.post(\n  \"/two\", authenticate);\nserver.all(`/three`)"
    )
    got = {r.route_path: r for r in RT.routes_express(make_files({("r", "a.js"): text})).collect()}
    assert {(p, r.method, r.line) for p, r in got.items()} == {("/one", "GET", 2), ("/two", "POST", 4), ("/three", "ALL", 6)}
    assert got["/one"].authentication == "not detected"
    assert got["/one"].risk_flags == ["NO_AUTH", "NO_AUTHORIZATION", "UNPROTECTED_DB_ACCESS"]
    assert got["/three"].authentication == "detected"  # the 200 characters before reach its neighbour


def test_routes_match_brute_force(spark):
    """Express call sites of the whole corpus against a plain scan of each text."""
    files = corpus_files(spark, SF_DIR)
    got = sorted((r.repo_id, r.file, r.method, r.route_path, r.line) for r in RT.routes_express(files).collect())
    expected = []
    for f in files.collect():
        if re.search(V.NEXT_APP_PATH, f.path) or re.search(V.NEXT_PAGES_PATH, f.path):
            continue
        if f.path.endswith(V.EXPRESS_EXT):
            for m in re.finditer(V.EXPRESS_ROUTE, f.content, re.I):
                expected.append((f.repo_id, f.path, m.group(2).upper(), m.group(3), f.content[: m.start()].count("\n") + 1))
    assert got == sorted(expected) and got


def test_next_routes(spark, make_files):
    files = make_files(
        {
            ("r", "app/(shop)/a/[id]/route.ts"): "export async function get(req) {}\nexport const POST = 1;",
            ("r", "app/route.ts"): "export function GET() {}",
            ("r", "pages/api/index.js"): "handler",
            ("r", "pages/api/u/x.tsx"): "if (req.method === 'PUT') {}",
        }
    )
    assert sorted((r.method, r.route_path) for r in RT.routes(files).collect()) == [
        ("GET", "/a/[id]"),
        ("GET", "/api/"),
        ("POST", "/a/[id]"),
        ("POST", "/api/"),
        ("PUT", "/api/u/x"),
    ]


def test_dependencies(spark, make_files):
    files = make_files(
        {
            ("r", "package.json"): '{"dependencies": {"a": "1", "b": "2", "n": 3}, "devDependencies": {"b": "9"}}',
            ("r", "package-lock.json"): '{"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/z": {"version": "5"}}}',
            ("r", "requirements.txt"): "# c\nflask == 3\nx>=1.0 \n-e .\n",
            ("r", "sub/package.json"): '{"dependencies": {"ignored": "1"}}',
            ("bad", "package.json"): '{"dependencies": {"a": "1"}',
        }
    )
    got = sorted((r.repo_id, r.name, r.version, r.type, r.source_file) for r in D.dependencies(files).collect())
    assert got == [
        ("r", "a", "1", "direct", "package.json"),
        ("r", "b", "9", "direct", "package.json"),
        ("r", "n", "3", "direct", "package.json"),
        ("r", "x", "1.0", "direct", "requirements.txt"),
        ("r", "z", "5", "transitive", "package-lock.json"),
    ]


def test_env_names(spark, make_files):
    names = "\n".join(f"process.env.V{i:03d}" for i in range(300))
    files = make_files(
        {
            ("r", ".env.example"): "A=1\n# B\nC = 2",
            ("r", ".env.local"): "C=",
            ("r", "a.js"): names + " process.env.PORT process.env.A",
            ("s", "a.js"): "process.env.X",
        }
    )
    rows = E.env_names(E.env_rows(files))
    assert E.undocumented_env(rows, files).count() == 300
    assert [(r.path, r.name) for r in E.missing_env(rows, files).collect()] == [(".env.local", "A")]
    hits = {r.ord: r.text for r in E.env_hits(rows, files).collect()}
    assert "Undocumented variables: V000, V001, V002 (300 in all)" in hits.values()


def test_env_evidence(spark, make_files):
    """Every name is a row, and identities differ for sets that a count and a sum of hashes might not tell apart."""
    names = "\n".join(f"process.env.V{i:03d}" for i in range(300))
    files = make_files({("r", ".env.example"): "A=1", ("r", "a.js"): names, ("s", ".env.example"): "A=1\nB=2", ("s", ".env"): "Q=1"})
    audit = Audit(files)
    rows = audit.evidence.join(audit.findings.select("repo_id", "fingerprint", "rule_id"), ["repo_id", "fingerprint"]).collect()
    assert sorted(r.snippet for r in rows if (r.repo_id, r.rule_id) == ("r", "CONFIG-007")) == [f"V{i:03d}" for i in range(300)]
    assert sorted((r.file, r.item) for r in rows if r.rule_id == "CONFIG-005") == [(".env", "A"), (".env", "B")]
    assert all(r.item == "" and r.snippet for r in rows if not r.rule_id.startswith("CONFIG-00"))
    sets = [("a", n) for n in "xyz"] + [("b", n) for n in "zyx"] + [("c", n) for n in ("x", "yz")] + [("d", n) for n in "xyw"]
    told = {r.repo_id: (r.n, r.identity) for r in E.set_identity(spark.createDataFrame(sets, "repo_id string, name string")).collect()}
    assert told["a"] == told["b"] and len(set(told.values())) == 3


@pytest.fixture(scope="module")
def corpus_audit(spark):
    return Audit(corpus_files(spark, SF_DIR))


def test_sarif_logs(spark, corpus_audit, tmp_path):
    """One log a repository, whole: rules once, results in order of place, each naming its rule by number."""
    written = DOC.write_documents(corpus_audit.sarif_report(), str(tmp_path), ".sarif").collect()
    assert sorted(r.repo_id for r in written) == sorted(r.repo_id for r in corpus_audit.repos.collect())
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(r.file for r in written)
    seen = []
    for w in written:
        assert (tmp_path / w.file).stat().st_size == w.bytes
        log = json.loads((tmp_path / w.file).read_text())
        assert log["version"] == "2.1.0" and log["$schema"].endswith("sarif-schema-2.1.0.json")
        run = log["runs"][0]
        rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert rules == sorted(set(rules)) and {r["ruleId"] for r in run["results"]} == set(rules)
        places = []
        for r in run["results"]:
            place = r["locations"][0]["physicalLocation"]
            assert r["level"] in ("error", "warning", "note") and rules[r["ruleIndex"]] == r["ruleId"]
            places.append((place["artifactLocation"]["uri"], place["region"]["startLine"]))
            seen.append((w.repo_id, r["partialFingerprints"]["primaryLocationLineHash"]))
        assert [p[0] for p in places] == sorted(p[0] for p in places) and min(p[1] for p in places) >= 1
    assert len(seen) == len(set(seen)) == corpus_audit.findings.count()


def test_json_documents(spark, corpus_audit, tmp_path):
    written = DOC.write_documents(corpus_audit.json_report({"run": "7"}), str(tmp_path)).collect()
    docs = {w.repo_id: json.loads((tmp_path / w.file).read_text()) for w in written}
    found = corpus_audit.findings.collect()
    assert set(docs) == {r.repo_id for r in corpus_audit.repos.collect()}
    proof = corpus_audit.evidence.groupBy("repo_id", "fingerprint").count().collect()
    for repo, doc in docs.items():
        assert list(doc) == [
            "project", "scan_metadata", "technologies", "frameworks", "dependency_counts", "dependencies", "routes", "graph_summary",
            "baseline_status", "findings", "scores", "explanations", "readiness", "categories", "analyzers", "summary",
        ]
        assert doc["scan_metadata"]["run"] == "7" and doc["summary"]["status"] == doc["scores"]["status"]
        assert sorted(f["fingerprint"] for f in doc["findings"]) == sorted(r.fingerprint for r in found if r.repo_id == repo)
        ranks = [f["severity_rank"] for f in doc["findings"]]
        assert ranks == sorted(ranks, reverse=True)
        assert {f["fingerprint"]: len(f["evidence"]) for f in doc["findings"]} == {r.fingerprint: r["count"] for r in proof if r.repo_id == repo}
        text = json.dumps(doc)
        assert "sk_live_4eC39" not in text and "hunter22" not in text


def test_document_pieces(spark, tmp_path):
    """Empty lists, absent objects, one entry, many entries over several batches, odd names and characters."""
    repos = spark.createDataFrame([("a/b",), ("none",), ("many",)], "repo_id string")
    rows = [("a/b", "q\"\\ \u001b[1mé😀\n", 1)] + [("many", f"{i:06d}", i) for i in range(25_000)]
    listed = spark.createDataFrame(rows, "repo_id string, name string, n int").repartition(5)
    single = spark.createDataFrame([("many", None, 2)], "repo_id string, x string, y int")
    layout = ['{"list":[', DOC.entries(listed, "list", F.col("name")), '],"one":', ("one", DOC.one(single)), "}"]
    document = DOC.pieces(repos, layout)
    written = {r.repo_id: r for r in DOC.write_documents(document, str(tmp_path / "out")).collect()}
    docs = {repo: json.loads((tmp_path / "out" / w.file).read_text()) for repo, w in written.items()}
    assert docs["none"] == {"list": [], "one": None} and docs["a/b"] == {"list": [{"name": "q\"\\ é😀\n", "n": 1}], "one": None}
    assert [e["n"] for e in docs["many"]["list"]] == list(range(25_000)) and docs["many"]["one"] == {"y": 2}
    assert written["a/b"].file == "a%2Fb.json" and len(list((tmp_path / "out").iterdir())) == 3
    flat = DOC.flat(document).where("repo_id = 'a/b'").collect()
    assert sorted((r.section, r.field, r.value) for r in flat) == [("list", "n", "1"), ("list", "name", "q\"\\ é😀\n")]


def test_explain_how(spark, make_files):
    files = make_files({("r", "a.js"): "const a = req.query.a;\nchild_process.exec('x' + a);\nchild_process.exec(other + 1);"})
    found = FD.dedup_findings(family_findings(files, [i for i, r in enumerate(FD.RULES) if r.scope != "repo"]))
    assert {r.line for r in found.collect()} == {2, 3}
    told = FD.explain(found, FL.taint_flows(files)).collect()
    hows = [r.body for r in told if r.section == "HOW"]
    assert set(hows) == {"exec: a at a.js:1 is set from req.query.a, and at a.js:2 reaches child_process.exec('x' + a);"}
    for one in {r.fingerprint for r in told}:
        assert sorted(r.position for r in told if r.fingerprint == one) == list(range(sum(r.fingerprint == one for r in told)))
    assert not [r for r in FD.explain(found).collect() if r.section == "HOW"]


def test_every_rule_has_prose():
    assert {r.rule_id for r in FD.RULES} == set(RULE_PROSE)
    for prose in RULE_PROSE.values():
        assert all(prose[:-1]) and prose.references and all(r.startswith("https://") for r in prose.references)
        assert all(len(text) < 200 and text.endswith(".") for text in prose[:-1])


def test_explain_tells_rule_and_references(spark, make_files):
    files = make_files({("r", "a.js"): "eval(a);"})
    found = FD.dedup_findings(family_findings(files, [i for i, r in enumerate(FD.RULES) if r.rule_id == "CODE-001"]))
    told = {r.section: r.body for r in FD.explain(found).collect()}
    prose = RULE_PROSE["CODE-001"]
    assert (told["WHAT"], told["IMPACT"], told["PRODUCTION"], told["FIX"], told["WHY"]) == prose[:5]
    assert told["REFERENCES"].split("\n") == ["https://cwe.mitre.org/data/definitions/95.html"]
    own = FD.explain(found.withColumn("ord", F.lit(10_000))).collect()
    told = {r.section: r.body for r in own}
    assert told["WHAT"] == "eval call (Security)." and "REFERENCES" not in told and all(told.values())
    assert [r.position for r in own] == list(range(len(own)))


def test_failing_analyzer_does_not_stop_others(spark, make_files):
    files = make_files({("r", "a.js"): "eval(a);"})

    def broken_plan(_):
        raise ValueError("no plan")

    def broken_run(f):
        return family_findings(f, FD_CODE).withColumn("line", F.raise_error(F.lit("boom")).cast("int"))

    good = lambda f: family_findings(f, FD_CODE)
    found, status = run_custom(files, {"good": good, "plan": broken_plan, "run": broken_run})
    assert {r.analyzer: (r.status, r.findings_count) for r in status.collect()} == {
        "good": ("completed", 1),
        "plan": ("failed", 0),
        "run": ("failed", 0),
    }
    assert found.count() == 1 and "boom" in next(r.error for r in status.collect() if r.analyzer == "run")

    def slow(f):
        rows = family_findings(f, FD_CODE)
        return rows.mapInPandas(lambda batches: ((time.sleep(60), b)[1] for b in batches), rows.schema)

    found, status = run_custom(files, {"slow": slow, "good": good}, timeout=15)
    assert {r.analyzer: r.status for r in status.collect()} == {"slow": "failed", "good": "completed"} and found.count() == 1


def test_custom_analyzers_in_audit(spark, make_files):
    def todo(files):
        hits = files.where(F.col("content").contains("TODO")).select("repo_id", "path", F.lit(1).alias("line"), F.lit("eval(todo)").alias("text"), F.lit(FD_CODE[0]).alias("ord"))
        return FD.to_findings(hits)

    def broken(files):
        raise ValueError("no plan")

    files = make_files({("r", "a.js"): "// TODO", ("s", "b.js"): "x"})
    plain, audit = Audit(files), Audit(files, analyzers={"todo": todo, "broken": broken})
    got = {(r.repo_id, r.analyzer): (r.status, r.findings_count) for r in audit.analyzers.collect()}
    built_in = {(r.repo_id, r.analyzer): (r.status, r.findings_count) for r in plain.analyzers.collect()}
    assert got == built_in | {("r", "todo"): ("completed", 1), ("s", "todo"): ("completed", 0), ("r", "broken"): ("failed", 0), ("s", "broken"): ("failed", 0)}
    extra = set(audit.findings.select("repo_id", "file", "analyzer").collect()) - set(plain.findings.select("repo_id", "file", "analyzer").collect())
    assert {tuple(r) for r in extra} == {("r", "a.js", "todo")}


def test_one_scan_of_contents(spark):
    """The digest reads the text table once and shuffles nothing but the initial spread."""
    a = Audit(corpus_files(spark, SF_DIR), durable=False)
    plan = a.digest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange") <= 1


def test_rule_hits_stay_in_one_pass(spark):
    hits = explode_hits(rule_hits(corpus_files(spark, SF_DIR)))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("query", ["", "  EVAL "])
def test_search(spark, make_files, query):
    files = make_files({("r", "a.js"): "eval(a);\nnew Function(b);"})
    found = family_findings(files, FD_CODE)
    assert FD.search_findings(found, query).count() == (2 if not query else 1)
    assert FD.search_findings(found, query, "LOW").count() == 0


def test_audit_scans_its_source_for_contents_and_for_names_only(spark, make_files):
    """repositories, manifests, inventory and findings start from two scans of the source."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(path):
        seen.add(1)
        return True

    files = make_files({("r", "a.js"): "eval(x)", ("r", ".gitignore"): "b.js", ("q", "package.json"): "{}"})
    a = Audit(files.filter(counted.asNondeterministic()("path")))
    assert a.active.count() and a.repos.count() == 2
    assert seen.value == 2 * 3


def test_json_report_reads_stored_sections(spark, make_files):
    """the document's plan does not hold the audit, whose digest has the column."""
    a = Audit(make_files({("r", "a.js"): "eval(x)", ("r", ".env.example"): "A="}))
    plan = a.json_report()._jdf.queryExecution().analyzed().toString()
    assert "referenced" not in plan and "kept_text" not in plan


def test_lines_are_searched_once_for_all_words(spark, make_files):
    """F4 to F17: lines without a word of any rule or file search are dropped before they are described."""
    files = make_files({("r", "a.js"): "prose\nmore prose\neval(x)\n", ("r", "Dockerfile"): "FROM a\nprose"})
    kept = rule_hits(files, extra={"low": F.col("low")}).collect()
    assert {r.path: r.low for r in kept} == {"a.js": "eval(x)", "Dockerfile": "from a\nprose"}


def test_flows_read_contents_once(spark):
    """sources and sinks come from one scan."""
    plan = FL.taint_flows(corpus_files(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_flow_words_let_every_flow_through(spark, make_files):
    """each form of source and sink, in any case, ends in a flow."""
    sources = ("REQ.query.a", "searchParams.get(", "params.a", "Request.args['a']")
    sinks = {
        "sql": ("db.QUERY(a + b)", "prisma.$queryRaw(a + b)", "sequelize.query(a + b)", "session.query(a + b)", "Select x + a FROM b"),
        "exec": ("child_process.exec(a)", "spawn(a)", "os.system(a)", "subprocess.run(a)"),
        "fs": ("fs.unlink(a)", "OPEN (a)"),
        "ssrf": ("fetch(a)", "axios.get(a)", "requests.post(a)", "urllib(a)"),
        "xss": ("dangerouslySetInnerHTML(a)", "x.innerHTML = a", "document.write(a)"),
    }
    cases = [(s, k, t) for s in sources for k, all_of in sinks.items() for t in all_of]
    files = make_files({("r", f"f{i}.js"): f"a = {s}\n\n{t}" for i, (s, _, t) in enumerate(cases)})
    found = {(r.file, r.kind, r.sink_expr, r.source_line) for r in FL.taint_flows(files).collect() if r.variable == "a"}
    assert found >= {(f"f{i}.js", k, t, 1) for i, (_, k, t) in enumerate(cases)}


def test_a_micro_batch_of_one_file_is_audited_by_all_tasks(spark, make_files):
    """F8: rows of one split are dealt over the cores, none lost."""
    files = make_files({("r", f"f{i}.js"): f"eval({i})" for i in range(400)}).coalesce(1)
    sizes = dealt(files).rdd.glom().map(len).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 400 and min(sizes) > 0


def test_call_sites_search_contents_once_for_their_groups(spark, make_files):
    """F4 to F17: method and path come from the texts of the matches; three searches of contents are for the code around."""
    body = "APP.get('/a', f);\nrouter . x\nserver.all(`/b`, g); app.put(\"/c\")\n"
    found = RT.routes_express(make_files({("r", "s.js"): body}))
    assert sorted((r.method, r.route_path, r.line) for r in found.collect()) == [("ALL", "/b", 3), ("GET", "/a", 1), ("PUT", "/c", 3)]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(content") == 4


def test_names_of_the_corpus_are_listed_without_its_texts(spark):
    """F5 to F16: the listing neither reads nor shuffles texts, and gates read policies from stored root files."""
    a = _audit(spark, SF_DIR)
    plan = a.listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:" in plan and "text" not in plan and "Exchange" not in plan
    own = Audit(corpus_files(spark, SF_DIR), durable=False).listing.collect()
    assert sorted(map(tuple, a.listing.collect())) == sorted(map(tuple, own)) == sorted(map(tuple, corpus_paths(spark, SF_DIR).collect()))
    assert load_policies(a.roots).exceptAll(load_policies(a.source)).isEmpty() and load_policies(a.source).exceptAll(load_policies(a.roots)).isEmpty()


def test_audits_that_differ_in_filters_share_what_is_stored(spark, make_files):
    """F10, F13, F16: one digest serves all of them, and each has its own results."""
    files = make_files({("r", "a.js"): "eval(x)\nel.innerHTML = y;\nconsole.log(debug)", ("q", "package.json"): "{}"})
    whole = Audit(files)
    assert whole.scored.count() == 2
    for options in ({"category": "sEcUrItY"}, {"min_severity": "HIGH"}, {"category": "Testing", "min_severity": "LOW"}):
        shared, alone = whole.narrowed(**options), Audit(files, **options)
        assert shared.digest is whole.digest and shared.active is whole.active
        for name in ("findings", "scored", "gates", "baseline_counts"):
            assert sorted(map(str, getattr(shared, name).collect())) == sorted(map(str, getattr(alone, name).collect())), name
    assert whole.findings.count() == whole.active.count()
    assert _audit(spark, SF_DIR, category="Testing").digest is _audit(spark, SF_DIR).digest
