"""File trees, files tables and the stream of arriving files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from auditloom.operators import fixed_values as V
from auditloom.operators.baseline import write_baseline
from auditloom.operators.rules import family_rules
from auditloom.plans.audit import Audit, family_findings
from auditloom.sources.files import (
    filter_extension,
    filter_gitignored,
    filter_ignored_paths,
    load_suppressions,
    read_files_table,
    scan_files,
    write_files_table,
)
from auditloom.sources.tree import list_tree, read_listed, unread, write_tree
from auditloom.streaming.incremental import FILES_SCHEMA, ToldFindings, batch_findings, read_file_stream, start_incremental_audit


def tree(root):
    for path, text in {
        "r1/src/a.js": "eval(a);",
        "r1/node_modules/x/b.js": "eval(b);",
        "r1/big.js": "x" * (1024 * 1024 + 1),
        "r2/Dockerfile": "USER root",
        "r2/.gitignore": "/gen/\n*.tmp",
        "r2/gen/c.PY": "x",
        "r2/deep/gen/d.py": "x",
        "r2/.github/workflows/ci.yml": "uses: a/b@v1",
        "r2/.git/config": "x",
        "r2/.auditignore": "# c\n DEP-001 \n\nX",
    }.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def test_scan_files(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "r1" / "logo.png").write_bytes(b"\x89PNG\xff\xfe ok")
    (tmp_path / "r2" / ".bin").write_bytes(b"a\xff")
    again = tmp_path / "r2" / str(tmp_path).lstrip("/") / "with blank.js"
    again.parent.mkdir(parents=True)
    again.write_text("eval(z);")
    files = scan_files(spark, str(tmp_path))
    texts = {(r.repo_id, r.path): r.content for r in files.collect()}
    assert texts["r1", "logo.png"] == "\ufffdPNG\ufffd\ufffd ok" and texts["r2", ".bin"] == "a\ufffd"
    assert texts["r2", ".github/workflows/ci.yml"] == "uses: a/b@v1" and ("r2", ".git/config") not in texts
    paths = {(r.repo_id, r.path) for r in files.collect()}
    assert ("r1", "src/a.js") in paths and ("r1", "big.js") in paths
    assert ("r2", str(again.relative_to(tmp_path / "r2"))) in paths
    limited = scan_files(spark, str(tmp_path), 1024 * 1024)
    assert ("r1", "big.js") not in {(r.repo_id, r.path) for r in limited.collect()}
    assert "LessThanOrEqual(length" in limited._jdf.queryExecution().executedPlan().toString()
    kept = {r.path for r in filter_ignored_paths(files).collect()}
    assert "node_modules/x/b.js" not in kept
    assert {r.path for r in filter_extension(files, [".py", "Dockerfile"]).collect()} == {
        "Dockerfile",
        "gen/c.PY",
        "deep/gen/d.py",
    }
    assert not {"gen/c.PY", "deep/gen/d.py"} & {r.path for r in filter_gitignored(files).collect()}
    assert sorted(r.token for r in load_suppressions(files).collect()) == ["DEP-001", "X"]


def test_files_table_round_trip(spark, make_files, tmp_path):
    files = make_files({("r", "a.js"): "eval(a);", ("r", "b.py"): "eval(b)"})
    path = str(tmp_path / "t")
    write_files_table(files, path)
    back = read_files_table(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))
    only_js = spark.read.parquet(path).filter("ext = '.js'")
    assert "PartitionFilters: [isnotnull(ext" in only_js._jdf.queryExecution().executedPlan().toString()


def _walked(root):
    """What a plain walk finds: hidden files only outside default ignored directories, links to directories not followed."""
    out = set()
    for folder, _, names in os.walk(root):
        for name in names:
            repo, _, path = os.path.relpath(os.path.join(folder, name), root).partition("/")
            parts = path.split("/")
            if path and not (any(p[0] in "._" for p in parts) and any(p in V.DEFAULT_IGNORED for p in parts[:-1])):
                out.add((repo, path))
    return out


@pytest.mark.parametrize("dirs_per_row", [1, 3, 1000])
def test_listing_by_many_tasks(spark, tmp_path, dirs_per_row):
    """One repository of many directories: several tasks list it, and the rows do not hang on how it is dealt."""
    for i in range(30):
        folder = tmp_path / "wide" / f"d{i}" / ("node_modules" if i % 5 == 0 else "src") / "x"
        folder.mkdir(parents=True)
        for name in ("a.js", ".hidden", "_b.py", "ü ß.ts"):
            (folder / name).write_text(name)
    (tmp_path / "wide" / "d1" / ".git").mkdir()
    (tmp_path / "wide" / "d1" / ".git" / "config").write_text("x")
    (tmp_path / "wide" / "loop").symlink_to(tmp_path / "wide")
    (tmp_path / "empty").mkdir()
    (tmp_path / "top.txt").write_text("belongs to no repository")
    listed = list_tree(spark, str(tmp_path), dirs_per_row=dirs_per_row)
    assert {(r.repo_id, r.path) for r in listed.collect()} == _walked(tmp_path) and listed.where("error is not null").count() == 0
    tasks = listed.select(F.input_file_name().alias("f")).distinct().count()
    assert tasks == 1 if dirs_per_row == 1000 else tasks >= 4
    pruned = list_tree(spark, str(tmp_path), prune=["node_modules"], dirs_per_row=dirs_per_row)
    assert {(r.repo_id, r.path) for r in pruned.collect()} == {n for n in _walked(tmp_path) if "node_modules" not in n[1]}
    texts = {(r.repo_id, r.path): r.content for r in read_listed(listed, str(tmp_path)).collect()}
    assert texts == {n: n[1].rsplit("/", 1)[1] for n in _walked(tmp_path)}


def test_unread_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.js").write_text("x")
    listed = list_tree(spark, str(tmp_path)).unionByName(
        spark.createDataFrame([("r", "big", 1 << 40, None), ("r", "gone.js", 5, None), ("r", "locked", None, "denied")], "repo_id string, path string, length long, error string")
    )
    assert [(r.path, r.content) for r in read_listed(listed, str(tmp_path)).collect()] == [("a.js", "x")]
    assert {r.path: r.reason for r in unread(listed).collect()} == {"big": "longer than a text may be", "locked": "denied"}
    with pytest.raises(FileNotFoundError):
        scan_files(spark, str(tmp_path / "absent"))


def test_tree_round_trip(spark, make_files, tmp_path):
    files = make_files({("r", "a b/ü.js"): "eval(a);\n", ("r", ".env"): "A=1", ("s", "deep/er/x"): ""})
    write_tree(files, str(tmp_path / "t"))
    assert sorted(map(tuple, scan_files(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, files.collect()))
    assert {r.path for r in scan_files(spark, f"file:{tmp_path}/t", hidden=False).collect()} == {"a b/ü.js", "deep/er/x"}
    with pytest.raises(Exception, match="leave their repository"):
        write_tree(make_files({("r", "../x"): "x"}), str(tmp_path / "t"))


NOW = dt.datetime(2024, 1, 1)


def test_incremental_audit(spark, make_files, tmp_path):
    rows = [
        ("r", "a.js", 8, "eval(a);", NOW),
        ("r", "a.js", 8, "eval(a);", NOW + dt.timedelta(minutes=1)),
        ("r", "b.js", 17, "new Function(b);", NOW),
        ("s", "known.js", 8, "eval(k);", NOW),
        ("s", "dist/c.js", 8, "eval(c);", NOW),
    ]
    inbox = str(tmp_path / "in")
    spark.createDataFrame(rows, FILES_SCHEMA).write.parquet(inbox)
    known = make_files({("s", "known.js"): "eval(k);"})
    write_baseline(family_findings(known, family_rules("code")), str(tmp_path / "base"))
    out = str(tmp_path / "out")

    def run():
        query = start_incremental_audit(
            read_file_stream(spark, inbox),
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"),
            str(tmp_path / "cp"),
            str(tmp_path / "base"),
            compact_every=2,
        )
        query.awaitTermination(120)
        return sorted((r.repo_id, r.file, r.rule_id, r.line) for r in spark.read.parquet(out).collect())

    first = [("r", "a.js", "CODE-001", 1), ("r", "b.js", "CODE-002", 1)]
    assert run() == first
    # a year late, with old rows among new ones, over several restarts and folders written together
    for k in range(5):
        late = [("r", "a.js", 8, "\neval(a);", NOW - dt.timedelta(days=365)), ("r", f"n{k}.js", 20, f"x\neval({k});\neval({k});", NOW), *rows]
        spark.createDataFrame(late, FILES_SCHEMA).write.mode("append").parquet(inbox)
        first.append(("r", f"n{k}.js", "CODE-001", 2))
        assert run() == sorted(first)


def test_told_findings_replayed(spark, make_files, tmp_path):
    """A micro-batch that is run again, whole or after half its writes, tells the same rows."""
    batches = [batch_findings(make_files({("r", f"{k % 3}.js"): "eval(a);", ("r", f"new{k}.js"): "eval(b);"})) for k in range(6)]
    once, again = ToldFindings(spark, str(tmp_path / "a"), 2), ToldFindings(spark, str(tmp_path / "b"), 2)
    want = [sorted(r.file for r in once.tell(b, k).collect()) for k, b in enumerate(batches)]
    got = []
    for k, b in enumerate(batches):
        for _ in range(2):
            rows = sorted(r.file for r in again.tell(b, k).collect())
        again.tell(b.where("false"), k + 1)  # begun and lost
        got.append(rows)
    assert got == want and sum(want, []) == ["0.js", "new0.js", "1.js", "new1.js", "2.js", "new2.js", "new3.js", "new4.js", "new5.js"]
    assert once.all(6).count() == 9
    assert sorted(p.name for p in (tmp_path / "a").glob("upto=*")) == ["upto=1", "upto=3", "upto=5"]


def test_large_lockfile(spark, tmp_path):
    """A lockfile above any former limit is read: the inventory is whole and no lockfile is missed."""
    root = tmp_path / "r"
    root.mkdir()
    (root / "package.json").write_text('{"dependencies": {"p1": "1.0.0"}}')
    entries = ",".join(f'"node_modules/p{i}": {{"version": "1.0.{i}", "resolved": "{"x" * 100}"}}' for i in range(9000))
    (root / "package-lock.json").write_text(f'{{"packages": {{{entries}}}}}')
    assert (root / "package-lock.json").stat().st_size > 1024 * 1024
    audit = Audit(scan_files(spark, str(tmp_path)))
    assert audit.inventory.count() >= 9000
    assert "PKG-001" not in {r.rule_id for r in audit.findings.select("rule_id").collect()}
